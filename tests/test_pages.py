"""Extraction from pages."""

from pyspark.sql import functions as F

from uploadwatch.functions import pages
from uploadwatch.operators import identity
from uploadwatch.sources import crawl

CARD = '<div><a href="{link}" {attributes}>x</a>{rest}</div>'
GAP = "." * 1300
PAGE = GAP.join([
    CARD.format(link="/groups/60170/videos/8812340001", attributes='title="Harbour Night, part two"', rest='<a href="/groups/60170/">members</a> 41 views'),
    CARD.format(link="/reel/7003004005/", attributes="", rest='<b>Mountain Race Replay</b><a href="/pages/Club/Alpine/50206070">club</a> 7,2 rb Tayangan'),
    CARD.format(link="/watch?v=31415926535", attributes='aria-label="Cooking with Rice, whole show"', rest='<a href="/profile.php?id=27182818">owner</a><span>13K views</span>'),
])
DATA = '<a href="/reel/4040404/?y"> </a>' + "-" * 1200 + r'{"open":"\/reel\/4040404","title":"Caf\u00e9 Race","id":"60606","name":"Club"}'


def found(spark, html):
    rows = crawl.social_detections(spark.createDataFrame([("q", html, 3)], "query string, html string, seq bigint"), "now").filter("failure is null").orderBy("place").collect()
    return [(r.url, r.title, r.channel_id, r.channel_name, r.extra.view_count, r.place.page_seq * 100_000 + r.place.pos) for r in rows]


def test_result_page(spark):
    site = "https://www.facebook.com"
    assert found(spark, PAGE) == [
        (f"{site}/groups/60170/videos/8812340001", "Harbour Night, part two", "60170", "", 41, 300000),
        (f"{site}/reel/7003004005", "Mountain Race Replay", "50206070", "", 7200, 300001),
        (f"{site}/watch?v=31415926535", "Cooking with Rice, whole show", "27182818", "", 13000, 300002),
    ]


def test_empty_pages(spark):
    assert found(spark, "") == [] and found(spark, None) == [] and found(spark, "<p>nothing</p>") == []


def test_embedded_data(spark):
    r = spark.createDataFrame([(DATA,)], "h string").select(pages.data_title(F.col("h"), F.lit("4040404")), pages.data_channel(F.col("h"), F.lit("4040404")), pages.data_title(F.col("h"), F.lit("8"))).first()
    assert r[0] == "Café Race" and tuple(r[1]) == ("60606", "Club") and r[2] == ""


def test_unclosed_tags():
    card = '<div class="bstar-video-card"><a href="/video/2012345678901"><img alt="Film"></a></div>'
    assert [c["title"] for c in crawl.read_cards("<p>" * 20_000 + card)] == ["Film"]


def test_offsets_are_code_points(spark):
    html = "😀😀é" + '<a href="/reel/1234567/" title="A title here">x</a>'
    assert found(spark, html)[0][:2] == ("https://www.facebook.com/reel/1234567", "A title here")


def test_views(spark):
    cases = {"3.4M views": 3_400_000, "61 views": 61, "7,654 views": 7654, "2,3 rb Tayangan": 2300, "88 Tayangan": 88, '"play_count":{"count":31}': 31, '"view_count": 46': 46, "none": None}
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(cases)], "h string, i int").select(pages.views_near(F.col("h"), F.lit(0)), "i").orderBy("i").collect()
    assert [r[0] for r in rows] == list(cases.values())
    cards = {"8.5K Putar": 8500, "4,7 rb": 4700, "6 jt": 6_000_000, "9.876.543": None, "": None}
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(cards)], "h string, i int").select(pages.card_views(F.col("h")), "i").orderBy("i").collect()
    assert [r[0] for r in rows] == list(cards.values())


def test_cards():
    html = (
        '<div class="bstar-video-card"><a href="/en/video/2012345678901"><img alt="Film One"></a><span class="x-duration">12:30</span><a class="up-name" href="/space/u1">Up</a><i class="play">1.2K</i></div>'
        '<div class="bstar-video-card"><a href="/en/video/2012345678902">v</a><h3 class="bstar-video-card__title">Two</h3></div><a href="/en/video/2012345678901">again</a><a href="/en/play/2012345678903">series</a>'
    )
    cards = crawl.read_cards(html)
    assert [(c["video_id"], c["title"], c["channel_id"], c["channel_name"], c["duration"]) for c in cards] == [("2012345678901", "Film One", "u1", "Up", "12:30"), ("2012345678902", "Two", "bilibili_2012345678902", "", "")]


def test_short_cards_go(spark):
    html = "".join(f'<div class="bstar-video-card"><a href="/video/20000000000{k}"><img alt="t"></a><b class="duration">{d}</b></div>' for k, d in enumerate(("9:59", "10:00", "")))
    rows = crawl.bilibili_detections(spark.createDataFrame([("q", html, 0)], "query string, html string, seq bigint"), "now").collect()
    assert sorted(r.url[-1] for r in rows) == ["1", "2"]


def test_unknown_platforms_are_skipped(recwarn):
    assert crawl.enabled_platforms(env={"ENABLED_PLATFORMS": "bilibili, nowhere"}) == ["bilibili"] and crawl.enabled_platforms(env={}) == ["facebook"]
    assert len(recwarn) == 1


def test_identities(spark):
    next_data = '<script id="__NEXT_DATA__" type="x"> {"props":{"pageProps":{"userInfo":{"user":{"id":"99","nickname":"Nick"}}}}} </script>'
    channel = "UC" + "b" * 22
    cases = [
        ("facebook", "https://www.facebook.com/profile.php?id=5", None, ("5", "hint", 1.0)),
        ("facebook", "https://www.facebook.com/name", '<title>Shop | Site</title> "pageID": "77"', ("77", "Shop", 0.9)),
        ("facebook", "https://www.facebook.com/name", None, None),
        ("facebook", "https://www.facebook.com/name", 'fb://profile/8 "pageID":"9"', ("8", "hint", 0.9)),
        ("youtube", f"https://www.youtube.com/channel/{channel}", None, (channel, "hint", 1.0)),
        ("youtube", "https://www.youtube.com/@x", f'<title>X - YouTube</title>"channelId":"{channel}"', (channel, "X", 0.9)),
        ("telegram", "https://t.me/someone", None, ("someone", "hint", 0.5)),
        ("tiktok", "https://www.tiktok.com/@a.b", next_data, ("99", "Nick", 0.95)),
        ("tiktok", "https://www.tiktok.com/@a.b", "broken", ("a.b", "hint", 0.6)),
        ("elsewhere", "https://x.y", None, None),
    ]
    rows = spark.createDataFrame([(i, p, u, h) for i, (p, u, h, _) in enumerate(cases)], "i int, p string, u string, h string")
    got = rows.select(identity.identity(F.col("p"), F.col("u"), F.lit("hint"), F.col("h"), F.lit("now")).alias("x"), "i").orderBy("i").collect()
    assert [r.x and (r.x.permanent_id, r.x.display_name, r.x.confidence) for r in got] == [c[3] for c in cases]
    assert got[6].x.metadata == {"id_type": "username", "numeric_id_pending": "true"}


def test_page_identifier(spark):
    pages_ = spark.createDataFrame([("https://www.facebook.com/groups/9",), ("https://www.facebook.com/who",), ("https://www.facebook.com/",)], "url string")
    fetched = spark.createDataFrame([("https://www.facebook.com/who", '"entity_id":"3"')], "url string, html string")
    assert {r.page_id for r in identity.page_identifier(pages_, fetched).collect()} == {"9", "3", "unknown"}
