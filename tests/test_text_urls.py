"""Titles and addresses: fixed cases, and Python's own URL functions as a second opinion."""

from urllib.parse import parse_qs, quote_plus, urlencode, urlparse, urlunparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uploadwatch import config
from uploadwatch.functions import text, urls


def column(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select(make(F.col("x")), "i").orderBy("i").collect()]


def test_canonical_titles(spark):
    cases = {
        "VIDIO Premium": "vidio premium", "v1d10": "vidio", "$treaming": "", "$ecret": "secret", "Serie Malam 720p HD": "serie malam", "Streaming Kisah Hujan Full": "kisah hujan",
        "ＶＩＤＩＯ": "vidio", "kanal.tv/sore!": "kanal tv sorei", "|iga": "liga", "   ": "", "": "", "café x": "caf x", "ﬁlm": "film", None: "",
    }
    assert column(spark, list(cases), text.canonical) == list(cases.values())


def test_durations(spark):
    cases = {"1:02:03": 3723, "10:00": 600, "00:05": 5, "": None, "soon": None, "1:2:3:4": None, "x:10": None, None: None}
    assert column(spark, list(cases), text.duration_seconds) == list(cases.values())


def python_canonical(url):
    p = urlparse(url.strip())
    host = config.HOSTS.get(p.netloc.lower(), p.netloc.lower())
    kept = {k: v for k, v in parse_qs(p.query).items() if k not in config.NOISE_PARAMETERS}
    return urlunparse(((p.scheme or "https").lower(), host, p.path.rstrip("/") or "/", "", urlencode(kept, doseq=True), ""))


def test_canonical_urls(spark):
    cases = [
        "https://m.facebook.com/watch?v=1&utm_source=x", "HTTP://FB.com/x/?a=1&b=2&a=3#f", "fb.com/x", "/x/y/", "https://a.com", "https://a.com/p;q?x=%zz+1&e=&y=~*&ref=1", "//h.com/z//", "https://fb.com:80/q", "a b c?d=e f", " https://x.com/é?k=ü ", "",
        "https://l.facebook.com/l.php?u=https%3A%2F%2Fx.y%2Fz&fbclid=1",
    ]
    assert column(spark, cases, urls.canonical_url) == [python_canonical(u) for u in cases]


def test_canonical_urls_of_nulls(spark):
    assert column(spark, [None], urls.canonical_url) == [None]


def test_search_urls(spark):
    cases = ["a b", "x*y~z", "é&=?", "100%"]
    assert column(spark, cases, urls.search_url) == ["https://www.facebook.com/search/videos/?q=" + quote_plus(q) for q in cases]


@pytest.mark.parametrize("url, wanted", [
    ("https://www.facebook.com/watch?v=111&x=1", "https://www.facebook.com/watch?v=111"), ("/reel/5/", "https://www.facebook.com/reel/5"), ("/reels/5", "https://www.facebook.com/reels/5"),
    ("https://m.facebook.com/groups/1/videos/2/", "https://www.facebook.com/groups/1/videos/2"), ("/groups/x/videos/2", None), ("/page/live/9", "https://www.facebook.com/page/live/9"),
    ("/photo/a/7", "https://www.facebook.com/photo/a/7"), ("https://example.com/videos/1", None), ("/watch?v=abc", None), ("/someone", None), ("", None), ("/", None),
])
def test_video_urls(spark, url, wanted):
    assert column(spark, [url], urls.video_url) == [wanted]


def test_ids_in_urls(spark):
    social = {"https://www.facebook.com/profile.php?id=12": "12", "/groups/34/about": "34", "/pages/Media/Some-Page/123456/": "123456", "/pages/x/12345": None, "/watch?v=1": None, "/name": None, "/reel/1": None}
    assert column(spark, list(social), urls.social_id) == list(social.values())
    channel = {"https://www.youtube.com/channel/UC" + "a" * 22: "UC" + "a" * 22, "https://www.youtube.com/channel/UC" + "a" * 23: None, "https://www.youtube.com/@x": None}
    assert column(spark, list(channel), urls.channel_id) == list(channel.values())
    messenger = {"https://t.me/abcde": "abcde", "https://t.me/abc": None, "https://t.me/+abcdef": None, "https://t.me/a_b_c/1": None, "https://x.me/abcde": None}
    assert column(spark, list(messenger), urls.messenger_name) == list(messenger.values())
    short = {"https://www.tiktok.com/@a.b": "a.b", "https://tiktok.com/@a/video/1": None, "https://www.tiktok.com/a": None}
    assert column(spark, list(short), urls.short_video_name) == list(short.values())
    profile = {"123": "https://www.facebook.com/profile.php?id=123", "name": "https://www.facebook.com/name"}
    assert column(spark, list(profile), urls.profile_url) == list(profile.values())


@pytest.mark.parametrize("a, b, low, high", [
    ("", "", 1, 1), ("", "x", 0, 0), ("liga champions", "champions liga", 1, 1), ("liga champions vidio", "liga champions", 1, 1), ("title a", "title b", 0.857, 0.858), ("abc", "xyz", 0, 0), ("sinetron cinta", "berita pagi", 0, 0.5),
])
def test_similarity(a, b, low, high):
    assert low <= text.token_set_similarity(a, b) <= high


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_common_length_by_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert text.common_length(a, b) == table[-1][-1]
    words = [" ".join(s.split()) for s in (a, b)]
    assert text.token_set_similarity(*words) == text.token_set_similarity(*words[::-1])


def test_similarity_column(spark):
    rows = spark.createDataFrame([("V1dio Liga", "liga vidio"), (None, None), ("x", "")], "a string, b string")
    assert [r[0] for r in rows.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0]
