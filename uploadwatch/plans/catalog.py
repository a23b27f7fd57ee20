"""Queries over the generic tables, one or more per operator, with independent SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from uploadwatch import config, schemas
from uploadwatch.functions import pages as on_pages
from uploadwatch.functions import text, urls
from uploadwatch.operators import cluster, health, identity, registry, score, search
from uploadwatch.operators.growing import GrowingClusters
from uploadwatch.plans import adapters, run
from uploadwatch.plans.adapters import RUN_TS
from uploadwatch.scratch import scratch_path
from uploadwatch.sources import crawl, tables
from uploadwatch.sources.buckets import BucketTable

WHITELIST = ("src0", "src3", "src7")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def canonical_sql(x: str) -> str:
    spelled, plain = "".join(config.LEET), "".join(config.LEET.values())
    return f"array_to_string(list_filter(string_split(regexp_replace(translate(lower({x}), '{spelled}', '{plain}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({listed(config.STOPWORDS)})), ' ')"


def url_sql(x: str) -> str:
    """For plain http addresses whose parameters need no encoding."""
    whole = f"split_part({x}, '#', 1)"
    front = f"regexp_replace(split_part({whole}, '?', 1), '/+$', '')"
    front = f"replace(CASE WHEN regexp_matches({front}, '^https?://[^/]+$') THEN {front} || '/' ELSE {front} END, '://m.facebook.com', '://www.facebook.com')"
    kept = f"array_to_string(list_filter(string_split(split_part({whole}, '?', 2), '&'), lambda p: regexp_matches(p, '=.') AND split_part(p, '=', 1) NOT IN ({listed(config.NOISE_PARAMETERS)})), '&')"
    return f"{front} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


STAMP = "strftime(TIMESTAMP '2026-01-01' + to_seconds({}), '%Y-%m-%dT%H:%M:%SZ')"
DOCS = f"""docs AS (
  SELECT lang AS platform, 'https://m.facebook.com/watch?v=' || (CASE WHEN doc_id % 5 = 1 THEN doc_id - 1 ELSE doc_id END) || (CASE WHEN doc_id % 2 = 0 THEN '&utm_source=x' ELSE '' END) AS url,
    left(split_part(text, chr(10), 1), 80) AS title, source AS channel_id, text AS snapshot_html, {STAMP.format("doc_id")} AS detected_at, doc_id AS seq
  FROM documents)"""
PAGES = f"""pgs AS (
  SELECT 'web' AS platform, url, coalesce(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '') AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS channel_id, html AS snapshot_html, {STAMP.format("page_id")} AS detected_at, page_id AS seq
  FROM pages)"""
EVENTS = """ev AS (
  SELECT event_type AS platform, CAST(user_id AS VARCHAR) AS permanent_id, 'user ' || user_id || ' #' || (event_id % 3) AS display_name, 'https://p.example/' || user_id AS profile_url, 'https://v.example/' || (event_id % 7) AS url,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS detected_at, event_id AS seq, CAST(floor(value * 1000) AS BIGINT) AS views, CAST(json_extract_string(props, '$.k') AS INTEGER) AS age
  FROM events)"""


# Titles and addresses ---------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT seq, {canonical_sql('title')} AS norm FROM docs")
def normalize_titles(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select("seq", text.canonical(F.col("title")).alias("norm"))


@query(f"WITH {DOCS} SELECT length({canonical_sql('snapshot_html')}) AS kept_chars, seq FROM docs")
def normalize_whole_texts(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select("seq", F.length(text.canonical(F.col("snapshot_html"))).cast("bigint").alias("kept_chars"))


@query(f"WITH {PAGES} SELECT seq, {url_sql('url')} AS canonical FROM pgs")
def normalize_urls(spark, sf_dir):
    return adapters.pages(spark, sf_dir).select("seq", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH {PAGES} SELECT channel_id, count(*) AS pages, count(DISTINCT {url_sql('url')}) AS distinct_urls FROM pgs GROUP BY channel_id")
def url_noise_stats(spark, sf_dir):
    d = adapters.pages(spark, sf_dir).select("channel_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return d.groupBy("channel_id").agg(F.count("*").alias("pages"), F.count_distinct("canonical").alias("distinct_urls"))


_EVASION_SQL = ", ".join(f"(3, {k}, ' {v}')" for k, v in enumerate(v for t in config.BRAND_TERMS for v in config.EVASIONS.get(t, ())))
_FORMS_SQL = ", ".join(f"(1, {k}, ' {t}')" for k, t in enumerate(config.BRAND_TERMS)) + ", (2, 0, ''), " + _EVASION_SQL


def _expand_sql(limit: str) -> str:
    return f"""WITH t AS (SELECT item_id AS seq, {canonical_sql("array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ')")} AS norm FROM benchmark),
    f(class, pos, suffix) AS (VALUES {_FORMS_SQL}),
    q AS (SELECT norm || suffix AS query, seq, class, pos FROM t, f WHERE norm <> ''),
    k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query ORDER BY seq, class, pos) = 1)
    SELECT query, CAST(row_number() OVER (ORDER BY class, seq, pos) AS INTEGER) AS rank FROM k ORDER BY rank {limit}"""


@query(_expand_sql("LIMIT 50"))
def expand_queries(spark, sf_dir):
    return search.expand(adapters.titles(spark, sf_dir))


@query(f"SELECT query, class FROM ({_expand_sql('').replace('SELECT query, CAST(row_number() OVER (ORDER BY class, seq, pos) AS INTEGER) AS rank', 'SELECT query, CAST(class AS INTEGER) AS class, row_number() OVER (ORDER BY class, seq, pos) AS rank')})")
def expand_all_queries(spark, sf_dir):
    return search.expand(adapters.titles(spark, sf_dir), max_queries=None).select("query", "class")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 60 * 60 + event_id % 59 AS INTEGER) WHEN 1 THEN CAST(event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59 AS INTEGER) END AS seconds FROM events""")
def parse_duration(spark, sf_dir):
    n = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short, long = F.concat(two(n % 60), F.lit(":"), two(n % 59)), F.concat((n % 24).cast("string"), F.lit(":"), two(n % 60), F.lit(":"), two(n % 59))
    said = F.when(n % 5 == 0, short).when(n % 5 == 1, long).when(n % 5 == 2, "").when(n % 5 == 3, "soon")
    return adapters.table(spark, sf_dir, "events").select("event_id", text.duration_seconds(said).alias("seconds"))


def _kinds(number: str, *kinds: str):
    """A value by a number's rest, as Column."""
    n = F.col(number)
    return F.element_at(F.array(*(F.format_string(k.replace("#", "%1$s"), n.cast("string")) for k in kinds)), (n % len(kinds) + 1).cast("int"))


_VIDEO_KINDS = ("https://www.facebook.com/watch/?v=#&x=1", "/reel/#/", "/groups/5/videos/#", "https://m.facebook.com/page/live/#?a=b", "https://example.com/videos/#", "/watch?v=a#", "/photo/x/#", "/somebody")
_VIDEO_SQL = """CASE doc_id % 8 WHEN 0 THEN 'https://www.facebook.com/watch?v=' || doc_id WHEN 1 THEN 'https://www.facebook.com/reel/' || doc_id WHEN 2 THEN 'https://www.facebook.com/groups/5/videos/' || doc_id
  WHEN 3 THEN 'https://www.facebook.com/page/live/' || doc_id WHEN 6 THEN 'https://www.facebook.com/photo/x/' || doc_id END"""


@query(f"SELECT doc_id, {_VIDEO_SQL} AS url, CASE WHEN doc_id % 8 < 4 THEN CAST(doc_id AS VARCHAR) END AS video_id FROM documents")
def fb_video_url(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", urls.video_url(_kinds("doc_id", *_VIDEO_KINDS)).alias("url"))
    return d.select("doc_id", "url", urls.video_id(F.col("url")).alias("video_id"))


_ID_KINDS = ("https://www.facebook.com/profile.php?id=7#&ref=x", "https://www.facebook.com/pages/Media/Name/1000#/", "https://www.facebook.com/groups/8#/about", "https://www.facebook.com/watch?v=#", "https://www.facebook.com/name.#")


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '7' || doc_id WHEN 1 THEN CASE WHEN length('1000' || doc_id) >= 6 THEN '1000' || doc_id END WHEN 2 THEN '8' || doc_id END AS permanent_id,
    CASE doc_id % 5 WHEN 0 THEN '7' || doc_id WHEN 1 THEN CASE WHEN length('1000' || doc_id) >= 6 THEN '1000' || doc_id ELSE 'pages' END WHEN 2 THEN '8' || doc_id WHEN 3 THEN 'watch' ELSE 'name.' || doc_id END AS channel_id FROM documents"""
)
def fb_ids_from_url(spark, sf_dir):
    url = _kinds("doc_id", *_ID_KINDS)
    return adapters.table(spark, sf_dir, "documents").select("doc_id", urls.social_id(url).alias("permanent_id"), urls.channel_of_page(url).alias("channel_id"))


_PROFILE_KINDS = ("https://www.youtube.com/channel/UCabcdefghijklmnopqrst_#", "https://t.me/user_#", "https://www.tiktok.com/@user.#", "https://t.me/+user_#", "https://www.youtube.com/@user#")


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 AND length(CAST(event_id AS VARCHAR)) = 1 THEN 'UCabcdefghijklmnopqrst_' || event_id END AS channel_id, CASE event_id % 5 WHEN 1 THEN 'user_' || event_id END AS messenger_name,
    CASE event_id % 5 WHEN 2 THEN 'user.' || event_id END AS short_video_name FROM events"""
)
def yt_tg_tt_ids(spark, sf_dir):
    url = _kinds("event_id", *_PROFILE_KINDS)
    return adapters.table(spark, sf_dir, "events").select("event_id", urls.channel_id(url).alias("channel_id"), urls.messenger_name(url).alias("messenger_name"), urls.short_video_name(url).alias("short_video_name"))


@query("SELECT page_id AS seq, 'https://www.facebook.com/search/videos/?q=' || replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '.', '+dot+') AS url FROM pages")
def search_urls(spark, sf_dir):
    return adapters.pages(spark, sf_dir).select("seq", urls.search_url(F.replace("channel_id", F.lit("."), F.lit(" dot "))).alias("url"))


# Pages ------------------------------------------------------------------------------------------------------

_FIRST_SQL = """CASE page_id % 4 WHEN 0 THEN 'https://www.facebook.com/watch?v=9' || page_id WHEN 1 THEN 'https://www.facebook.com/reel/9' || page_id
  WHEN 2 THEN 'https://www.facebook.com/groups/77/videos/9' || page_id ELSE 'https://www.facebook.com/page' || page_id || '/videos/9' || page_id END"""
_SECOND_SQL = "'https://www.facebook.com/reel/8' || page_id"


@query(f"SELECT page_id AS seq, 0 AS pos, {_FIRST_SQL} AS url FROM pages UNION ALL SELECT page_id, 1, {_SECOND_SQL} FROM pages")
def extract_video_links(spark, sf_dir):
    return adapters.result_pages(spark, sf_dir).select("seq", F.posexplode(on_pages.video_urls(F.col("html"))).alias("pos", "url"))


_OWNER_SQL = "CASE page_id % 3 WHEN 0 THEN '55' || page_id WHEN 1 THEN '66000' || page_id ELSE 'uploader' || page_id END"
_VIEWS_SQL = "CASE page_id % 4 WHEN 0 THEN CAST(page_id * 1000 AS BIGINT) WHEN 1 THEN 1200000 WHEN 2 THEN CAST(page_id * 1000 + 500 AS BIGINT) END"


@query(
    f"""SELECT {_FIRST_SQL} AS url, 'Title of ' || page_id AS title,
    CASE WHEN page_id % 3 = 1 AND length('66000' || page_id) < 6 THEN 'pages' ELSE {_OWNER_SQL} END AS channel_id, {_VIEWS_SQL} AS view_count, 'q' || (page_id % 10) AS query_used, page_id * 100000 AS seq FROM pages
    UNION ALL SELECT {_SECOND_SQL}, 'Second of ' || page_id, 'unknown', NULL, 'q' || (page_id % 10), page_id * 100000 + 1 FROM pages"""
)
def page_detections(spark, sf_dir):
    found = crawl.social_detections(adapters.result_pages(spark, sf_dir), RUN_TS)
    return found.select("url", "title", "channel_id", F.col("extra.view_count").alias("view_count"), "query_used", (F.col("place.page_seq") * 100_000 + F.col("place.pos")).alias("seq"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id * 1000 AS BIGINT) WHEN 1 THEN CAST(doc_id AS BIGINT) WHEN 2 THEN CAST(doc_id * 1000 + 500 AS BIGINT) END AS views FROM documents")
def view_counts(spark, sf_dir):
    said = _kinds("doc_id", "#K", "# Putar", "#,5 rb", "1.2.3")
    return adapters.table(spark, sf_dir, "documents").select("doc_id", on_pages.card_views(said).alias("views"))


@query("""SELECT page_id AS seq, 'Café ' || page_id AS title, '44000' || page_id AS owner_id, 'Owner ' || page_id AS owner_name, CAST(page_id * 3 AS BIGINT) AS views FROM pages""")
def embedded_data(spark, sf_dir):
    """What the data of a page tell of a video whose link has neither title nor owner."""
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit('<a href="/reel/90000'), n, F.lit('/"> </a>'), F.repeat(F.lit("."), 1200), F.lit('{"open":"\\/reel\\/90000'), n, F.lit('","title":"Caf\\u00e9 '), n, F.lit('","id":"44000'), n, F.lit('","name":"Owner '), n, F.lit('"},"play_count":{"count":'), (F.col("page_id") * 3).cast("string"), F.lit("}"))
    d = adapters.table(spark, sf_dir, "pages").select("page_id", html.alias("html"), F.concat(F.lit("90000"), n).alias("video"))
    owner = on_pages.data_channel(F.col("html"), F.col("video"))
    place = F.locate("play_count", F.col("html"))
    return d.select(F.col("page_id").alias("seq"), on_pages.data_title(F.col("html"), F.col("video")).alias("title"), owner["id"].alias("owner_id"), owner["name"].alias("owner_name"), on_pages.views_near(F.substring(F.col("html"), place - 1, F.lit(200)), F.lit(0)).alias("views"))


@query("SELECT page_id AS seq, 'https://www.bilibili.tv/en/search?keyword=' || replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '.', '+dot+') || '&type=VIDEO' AS url FROM pages")
def card_search_urls(spark, sf_dir):
    return adapters.pages(spark, sf_dir).select("seq", urls.card_search_url(F.replace("channel_id", F.lit("."), F.lit(" dot "))).alias("url"))


@query("""SELECT page_id AS seq, 'https://www.bilibili.tv/video/20' || lpad(CAST(page_id AS VARCHAR), 10, '0') AS url, 'Film ' || page_id AS title, 'up' || page_id AS channel_id, CAST(page_id % 3 * 600 + 30 AS INTEGER) AS seconds, page_id * 1000 AS view_count FROM pages WHERE page_id % 3 > 0""")
def card_detections(spark, sf_dir):
    n = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<div class="bstar-video-card x"><a href="/en/video/20'), F.lpad(n, 10, "0"), F.lit('"><img alt="Film '), n, F.lit('"></a><span class="card-duration">'), (F.col("page_id") % 3 * 10).cast("string"), F.lit(':30</span><a class="up-name" href="/space/up'), n,
        F.lit('">Name</a><i class="play-count">'), n, F.lit(" rb</i></div>"),
    )
    pages = adapters.table(spark, sf_dir, "pages").select(F.lit("q").alias("query"), html.alias("html"), F.col("page_id").alias("seq"))
    found = crawl.bilibili_detections(pages, RUN_TS)
    return found.select(F.col("place.page_seq").alias("seq"), "url", "title", "channel_id", F.col("extra.duration_secs").alias("seconds"), F.col("extra.view_count").alias("view_count"))


#: Of three result pages one has links that are no addresses before its card, and one has no text.
@query("""SELECT 'bilibili' AS platform, 'q' || (page_id % 7) AS query, page_id AS page_seq, CAST(page_id % 3 <> 1 AS INTEGER) AS n_found, CAST(CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS n_errors FROM pages""")
def crawl_errors(spark, sf_dir):
    """What each result page gives: detections and errors, side by side."""
    n = F.col("page_id").cast("string")
    card = F.concat(F.lit('<div class="bstar-video-card"><a href="/en/video/30'), F.lpad(n, 10, "0"), F.lit('"><img alt="Film '), n, F.lit('"></a></div>'))
    broken = F.lit('<a href="http://[x">?</a><a href="http://[y">?</a>')
    html = F.when(F.col("page_id") % 3 == 0, card).when(F.col("page_id") % 3 == 2, F.concat(broken, card))
    pages = adapters.table(spark, sf_dir, "pages").select(F.concat(F.lit("q"), (F.col("page_id") % 7).cast("string")).alias("query"), html.alias("html"), F.col("page_id").alias("seq"))
    found, lost = crawl.crawl({"bilibili": pages}, RUN_TS, ["bilibili"])
    number = F.regexp_extract("url", "30([0-9]{10})$", 1).cast("bigint").alias("page_seq")
    both = found.select("platform", F.col("query_used").alias("query"), number, F.lit(1).alias("good")).unionByName(lost.select("platform", "query", "page_seq", F.lit(0).alias("good")))
    return both.groupBy("platform", "query", "page_seq").agg(F.sum("good").cast("int").alias("n_found"), F.sum(1 - F.col("good")).cast("int").alias("n_errors"))


@query(f"WITH {PAGES} SELECT seq, " + " + ".join(f"CAST(contains(lower(snapshot_html), '{m}') AS INTEGER)" for m in ("href", "div", "script", "vidio")) + " AS hits FROM pgs")
def brand_markers(spark, sf_dir):
    return adapters.pages(spark, sf_dir).select("seq", score.marker_hits(F.col("snapshot_html"), ("href", "DIV", "script", "vidio")).alias("hits"))


# Identities -------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT seq, platform, channel_id FROM docs WHERE channel_id NOT IN ({listed(WHITELIST)})")
def whitelist_anti(spark, sf_dir):
    listed_channels = spark.createDataFrame([(c,) for c in WHITELIST], "channel_id string")
    return cluster.without_channels(adapters.documents(spark, sf_dir), listed_channels).select("seq", "platform", "channel_id")


@query(
    f"""WITH {DOCS}, d AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'facebook' WHEN 1 THEN 'telegram' ELSE 'bilibili' END AS site, CASE WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) ELSE channel_id END AS chan, CASE WHEN seq % 3 = 1 THEN 'https://t.me/user_' || seq ELSE url END AS link FROM docs)
    SELECT seq, CASE WHEN site = 'telegram' THEN 'user_' || seq ELSE chan END AS permanent_id, CASE WHEN site <> 'facebook' THEN link WHEN seq % 2 = 0 THEN 'https://www.facebook.com/profile.php?id=' || chan ELSE 'https://www.facebook.com/' || chan END AS profile_url,
    CAST(CASE WHEN site = 'telegram' THEN 0.5 WHEN site = 'facebook' AND seq % 2 = 0 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS confidence FROM d"""
)
def identity_fallback(spark, sf_dir):
    n = F.col("seq")
    d = adapters.documents(spark, sf_dir).withColumns(
        {"platform": F.element_at(F.array(F.lit("facebook"), F.lit("telegram"), F.lit("bilibili")), (n % 3 + 1).cast("int")), "channel_id": F.when(n % 2 == 0, n.cast("string")).otherwise(F.col("channel_id")), "url": F.when(n % 3 == 1, F.concat(F.lit("https://t.me/user_"), n.cast("string"))).otherwise(F.col("url"))}
    )
    found = identity.with_fallback(d, RUN_TS)
    return found.select("seq", "identity.permanent_id", "identity.profile_url", "identity.confidence")


@query(
    """WITH p AS (SELECT page_id, 'https://www.facebook.com/name' || (page_id % 50) AS url FROM pages), f AS (SELECT DISTINCT page_id % 50 AS k FROM pages)
    SELECT page_id AS seq, CASE WHEN page_id % 50 % 2 = 0 THEN '9000' || (page_id % 50) END AS permanent_id, CASE WHEN page_id % 50 % 2 = 0 THEN 'Shop ' || (page_id % 50) END AS display_name, CAST(CASE WHEN page_id % 50 % 2 = 0 THEN 0.9 END AS DOUBLE) AS confidence FROM p"""
)
def identity_fetched(spark, sf_dir):
    k = F.col("page_id") % 50
    url = F.concat(F.lit("https://www.facebook.com/name"), k.cast("string"))
    p = adapters.table(spark, sf_dir, "pages")
    fetched = p.select(k.alias("k")).distinct().select(
        F.concat(F.lit("https://www.facebook.com/name"), F.col("k").cast("string")).alias("url"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("<title>Shop "), F.col("k").cast("string"), F.lit(' | Site</title>"pageID": "9000'), F.col("k").cast("string"), F.lit('"'))).otherwise("<title>none</title>").alias("html"),
    )
    profiles = p.select(F.col("page_id").alias("seq"), F.lit("facebook").alias("platform"), url.alias("url"), F.lit("").alias("hint"))
    found = identity.resolve(profiles, fetched, RUN_TS)
    return profiles.join(found, ["platform", "url", "hint"]).select("seq", "identity.permanent_id", "identity.display_name", "identity.confidence")


@query(
    """SELECT page_id AS seq, 'UC' || lpad(CAST(page_id % 50 AS VARCHAR), 22, '0') AS permanent_id, 'Channel ' || (page_id % 50) AS display_name, CAST(0.9 AS DOUBLE) AS confidence,
    'https://www.youtube.com/channel/UC' || lpad(CAST(page_id % 50 AS VARCHAR), 22, '0') AS profile_url FROM pages"""
)
def identity_video_pages(spark, sf_dir):
    """Channels by handle, whose pages tell number and name."""
    k = (F.col("page_id") % 50).cast("string")
    p = adapters.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.lit("youtube").alias("platform"), F.concat(F.lit("https://www.youtube.com/@c"), k).alias("url"), F.lit("").alias("hint"), k.alias("k"))
    number = F.concat(F.lit("UC"), F.lpad("k", 22, "0"))
    fetched = p.select("url", "k").distinct().select("url", F.concat(F.lit("<title>Channel "), "k", F.lit(' - YouTube</title><script>{"channelId":"'), number, F.lit('"}</script>')).alias("html"))
    found = identity.resolve(p, fetched, RUN_TS)
    return p.join(found, ["platform", "url", "hint"]).select("seq", "identity.permanent_id", "identity.display_name", "identity.confidence", "identity.profile_url")


@query(
    """SELECT page_id AS seq, CASE WHEN page_id % 50 % 3 = 0 THEN '70' || (page_id % 50) ELSE 'user.' || (page_id % 50) END AS permanent_id, CASE WHEN page_id % 50 % 3 = 0 THEN 'Nick ' || (page_id % 50) ELSE '' END AS display_name,
    CAST(CASE WHEN page_id % 50 % 3 = 0 THEN 0.95 ELSE 0.6 END AS DOUBLE) AS confidence FROM pages"""
)
def identity_short_video_pages(spark, sf_dir):
    """Profiles whose pages hold data for one in three; the others fall back to the name in the address."""
    k = (F.col("page_id") % 50).cast("string")
    p = adapters.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.lit("tiktok").alias("platform"), F.concat(F.lit("https://www.tiktok.com/@user."), k).alias("url"), F.lit("").alias("hint"), k.alias("k"))
    data = F.concat(F.lit('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"userInfo":{"user":{"id":"70'), "k", F.lit('","nickname":"Nick '), "k", F.lit('"}}}}}</script>'))
    fetched = p.select("url", "k").distinct().select("url", F.when(F.col("k").cast("int") % 3 == 0, data).otherwise("<p>empty</p>").alias("html"))
    found = identity.resolve(p, fetched, RUN_TS)
    return p.join(found, ["platform", "url", "hint"]).select("seq", "identity.permanent_id", "identity.display_name", "identity.confidence")


@query(
    """SELECT event_type, count(*) AS pairs, count(*) FILTER (user_id % 7 = event_id % 7) AS same FROM events GROUP BY event_type"""
)
def same_identities(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    who = lambda c: F.struct(F.col("event_type").alias("platform"), (F.col(c) % 7).cast("string").alias("permanent_id"))
    return e.groupBy("event_type").agg(F.count("*").alias("pairs"), F.count_if(identity.same_identity(who("user_id"), who("event_id"))).alias("same"))


# Clusters ---------------------------------------------------------------------------------------------------

_URL_EDGES = f"SELECT seq AS a, first AS b FROM (SELECT seq, min(seq) OVER (PARTITION BY {url_sql('url')}) AS first FROM docs) WHERE seq > first"
_TITLE_EDGES = f"SELECT seq AS a, first AS b FROM (SELECT seq, min(seq) OVER (PARTITION BY platform, channel_id, {canonical_sql('title')}) AS first FROM docs) WHERE seq > first"


def _similar_sql(pairs: str) -> str:
    """compared: the rows of pairs (t1, t2, canonical titles of less than 120 letters) with their similarity.

    The common subsequence is found a row of bits at a time: a bit of the first text stays set until it is matched.
    """
    return f"""sorted_words AS (SELECT *, list_sort(list_distinct(string_split(t1, ' '))) AS x, list_sort(list_distinct(string_split(t2, ' '))) AS y FROM {pairs}),
shared AS (SELECT *, list_filter(x, lambda v: list_contains(y, v)) AS c, list_filter(x, lambda v: NOT list_contains(y, v)) AS l, list_filter(y, lambda v: NOT list_contains(x, v)) AS r FROM sorted_words),
spelled AS (SELECT *, array_to_string(c, ' ') AS cs, array_to_string(list_concat(c, l), ' ') AS cx, array_to_string(list_concat(c, r), ' ') AS cy FROM shared),
masked AS (SELECT *, (1::HUGEINT << length(cx)) - 1 AS whole, string_split(cx, '') AS xs, list_transform(string_split(cy, ''), lambda ch: list_sum(list_transform(range(length(cx)), lambda i: CASE WHEN substr(cx, i + 1, 1) = ch THEN 1::HUGEINT << i ELSE 0::HUGEINT END))) AS masks FROM spelled),
matched AS (SELECT *, length(cx) - bit_count(list_reduce(list_prepend(whole, masks), lambda v, k: ((v + (v & k)) | (v - (v & k))) & whole)) AS common FROM masked),
compared AS (SELECT *, CASE WHEN t1 = '' OR t2 = '' THEN CASE WHEN t1 = t2 THEN 1.0 ELSE 0.0 END WHEN len(c) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 1.0
  ELSE greatest(2 * common::DOUBLE / (length(cx) + length(cy)), CASE WHEN len(c) > 0 THEN 2 * length(cs)::DOUBLE / (length(cs) + least(length(cx), length(cy))) ELSE 0 END) END AS similarity FROM matched)"""


_FUZZY = f"""named AS MATERIALIZED (SELECT platform, channel_id, {canonical_sql('title')} AS t, min(seq) AS s FROM docs GROUP BY ALL HAVING t <> ''),
title_pairs AS MATERIALIZED (SELECT x.t AS t1, y.t AS t2, x.s AS s1, y.s AS s2 FROM named x JOIN named y ON x.platform = y.platform AND x.channel_id = y.channel_id AND x.s < y.s), {_similar_sql('title_pairs')},
fuzzy AS MATERIALIZED (SELECT s2 AS a, s1 AS b FROM compared WHERE similarity >= {config.FUZZY_THRESHOLD})"""


def _components_sql(docs: str = DOCS, fuzzy: bool = False) -> str:
    return f"""{docs}{', ' + _FUZZY if fuzzy else ''}, e AS MATERIALIZED ({_URL_EDGES} UNION {_TITLE_EDGES}{' UNION SELECT a, b FROM fuzzy' if fuzzy else ''}), both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, seen) AS (SELECT seq, seq FROM docs UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen),
parts AS MATERIALIZED (SELECT node AS seq, min(seen) AS component FROM reach GROUP BY node)"""


_COMPONENTS = _components_sql()


@query(f"WITH {DOCS} {_URL_EDGES}")
def dedupe_url_pass(spark, sf_dir):
    return cluster.url_edges(adapters.documents(spark, sf_dir))


@query(f"WITH {DOCS} {_TITLE_EDGES}")
def dedupe_title_pass(spark, sf_dir):
    return cluster.title_edges(adapters.documents(spark, sf_dir))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT seq, component FROM parts")
def dedupe_components(spark, sf_dir):
    return cluster.deduplicate(adapters.documents(spark, sf_dir), fuzzy_threshold=None).select("seq", "component")


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT seq, component FROM parts")
def dedupe_in_runs(spark, sf_dir):
    """Three runs, each taking in its detections beside the components that are kept."""
    every = adapters.documents(spark, sf_dir)
    kept = GrowingClusters(spark, scratch_path(spark, "growing"), 16)
    for n in range(3):
        kept.add(every.filter(F.pmod("seq", F.lit(3)) == 2 - n), ("runs", n))
    return every.select("seq").join(kept.read(), "seq", "left").withColumn("component", F.coalesce("component", "seq"))


_RANKED = """ranked AS (
  SELECT docs.*, component, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY length(snapshot_html) DESC, detected_at, docs.seq) AS place FROM docs JOIN parts USING (seq))"""
_CLUSTERS = f"{_COMPONENTS}, {_RANKED}"
_CLUSTER_ID_SQL = f"left(sha256(platform || chr(0) || channel_id || chr(0) || {url_sql('url')}), 16)"


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT component, seq, CAST(n AS INTEGER) AS cluster_size, left(sha256(platform || chr(0) || channel_id || chr(0) || {url_sql('url')}), 16) AS cluster_id FROM ranked WHERE place = 1")
def pick_canonical(spark, sf_dir):
    members = cluster.deduplicate(adapters.documents(spark, sf_dir), fuzzy_threshold=None)
    return cluster.clusters(members).select("component", "seq", "cluster_size", "cluster_id")


@query(f"WITH {PAGES} SELECT seq, left(sha256(platform || chr(0) || channel_id || chr(0) || {url_sql('url')}), 16) AS cluster_id FROM pgs")
def cluster_ids(spark, sf_dir):
    return adapters.pages(spark, sf_dir).select("seq", cluster.cluster_id(F.col("platform"), F.col("channel_id"), F.col("url")).alias("cluster_id"))


#: Two runs that overlap and together hold every row: some languages and sources are in one of them only.
_IN_OLD, _IN_NEW = "(platform <> 'de' AND channel_id <> 'src1')", "(platform = 'de' OR channel_id = 'src1' OR (platform <> 'fr' AND channel_id <> 'src2'))"


def _two_batches(spark, sf_dir):
    """Two runs over one set of clusters, some of which are in one run only."""
    d = adapters.documents(spark, sf_dir).withColumn("cluster_id", F.concat("channel_id", F.lit("-"), F.floor(F.col("seq") / 48).cast("string")))
    parts = []
    for side in (_IN_OLD, _IN_NEW):
        own = d.filter(side)
        best = cluster.pick_canonical(own, ["cluster_id"]).select("cluster_id", F.col("seq").alias("_best"))
        parts.append(own.join(best, "cluster_id").withColumn("is_canonical", F.col("seq") == F.col("_best")).drop("_best"))
    return parts


@query(
    f"""WITH {DOCS}, d AS (SELECT *, channel_id || '-' || (seq // 48) AS cluster_id, {url_sql('url')} AS canon FROM docs),
    s AS (SELECT *, 0 AS side FROM d WHERE {_IN_OLD} UNION ALL SELECT *, 1 FROM d WHERE {_IN_NEW}),
    c AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, side ORDER BY length(snapshot_html) DESC, detected_at, seq) = 1 AS canonical, min(side) OVER (PARTITION BY cluster_id) < max(side) OVER (PARTITION BY cluster_id) AS met FROM s),
    f AS (SELECT * FROM c QUALIFY NOT met OR row_number() OVER (PARTITION BY cluster_id, canon ORDER BY side, canonical DESC, seq) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY side, canonical DESC, seq) AS pool FROM f)
    SELECT cluster_id, seq, CASE WHEN met THEN row_number() OVER (PARTITION BY cluster_id ORDER BY length(snapshot_html) DESC, detected_at, pool) = 1 ELSE canonical END AS is_canonical, CAST(count(*) OVER (PARTITION BY cluster_id) AS INTEGER) AS cluster_size FROM p"""
)
def merge_clusters(spark, sf_dir):
    return cluster.merge(*_two_batches(spark, sf_dir)).select("cluster_id", "seq", "is_canonical", "cluster_size")


@query(f"WITH {DOCS}, {_FUZZY} SELECT a, b FROM fuzzy")
def dedupe_fuzzy(spark, sf_dir):
    return cluster.fuzzy_edges(adapters.documents(spark, sf_dir))


@query(f"WITH RECURSIVE {_components_sql(fuzzy=True)}, {_RANKED} SELECT component, seq, CAST(n AS INTEGER) AS cluster_size, {_CLUSTER_ID_SQL} AS cluster_id FROM ranked WHERE place = 1")
def dedupe_all_passes(spark, sf_dir):
    return cluster.clusters(cluster.deduplicate(adapters.documents(spark, sf_dir))).select("component", "seq", "cluster_size", "cluster_id")


# Scores -----------------------------------------------------------------------------------------------------


def _graded_sql(x: str, grades) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN {points}" for least, points in grades) + " ELSE 0 END"


_ITEM_TITLE_SQL = "array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ')"


@query(
    f"""WITH {DOCS}, items AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, {canonical_sql(_ITEM_TITLE_SQL)} AS t2, count(*) OVER () AS n FROM benchmark),
    met AS MATERIALIZED (SELECT seq, {canonical_sql('title')} AS t1, t2 FROM docs JOIN items ON k = seq % n), {_similar_sql('met')} SELECT seq, round(similarity, 9) AS similarity FROM compared"""
)
def title_similarity(spark, sf_dir):
    """Each document's title against one catalog title."""
    known = adapters.titles(spark, sf_dir).select(F.col("seq").alias("item"), "title").orderBy("item")
    n = known.count()
    numbered = known.select((F.row_number().over(Window.orderBy("item")) - 1).cast("bigint").alias("k"), F.col("title").alias("known"))  # a catalog is a list of titles
    d = adapters.documents(spark, sf_dir).select("seq", "title").withColumn("k", F.col("seq") % F.lit(max(n, 1)))
    return d.join(numbered, "k").select("seq", F.round(text.similarity(F.col("title"), F.col("known")), 9).alias("similarity"))


#: Points of each distinct canonical title of documents, by the best similarity with a catalog title.
_TITLE_POINTS = f"""said AS (SELECT DISTINCT {canonical_sql('title')} AS t1 FROM docs WHERE trim(title) <> ''), known AS (SELECT DISTINCT {canonical_sql("array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ')")} AS t2 FROM benchmark),
catalog_pairs AS MATERIALIZED (SELECT t1, t2 FROM said, known), {_similar_sql('catalog_pairs')},
title_points AS MATERIALIZED (SELECT t1, CAST({_graded_sql('max(similarity)', config.TITLE_GRADES)} AS INTEGER) AS points FROM compared GROUP BY t1)"""


@query(f"WITH {DOCS}, {_TITLE_POINTS} SELECT seq, CASE WHEN trim(title) = '' THEN 0 ELSE coalesce(points, 0) END AS points FROM docs LEFT JOIN title_points ON t1 = {canonical_sql('title')}")
def title_match(spark, sf_dir):
    return score.with_title_points(adapters.documents(spark, sf_dir), adapters.titles(spark, sf_dir)).select("seq", "points")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 20 WHEN 'click' THEN 10 ELSE 0 END AS points FROM events")
def fingerprint_score(spark, sf_dir):
    level = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "click", "likely").when(F.col("event_type") == "view", "other")
    return adapters.table(spark, sf_dir, "events").select("event_id", score.fingerprint_points(level).alias("points"))


@query(f"WITH {EVENTS}, n AS (SELECT platform, permanent_id, count(*) - 10 AS prior FROM ev GROUP BY ALL) SELECT platform, permanent_id, {_graded_sql('prior', config.REPEAT_GRADES)} AS points FROM n")
def repeat_history(spark, sf_dir):
    n = adapters.evidence(spark, sf_dir).groupBy("platform", "permanent_id").agg((F.count("*") - 10).alias("prior"))
    return n.select("platform", "permanent_id", score.repeat_points(F.col("prior")).alias("points"))


@query(f"WITH {EVENTS} SELECT seq, CASE WHEN views IS NULL OR age IS NULL THEN 0 ELSE {_graded_sql('CAST(views AS DOUBLE) / greatest(age, 1)', config.VIEW_RATE_GRADES)} END AS points FROM ev")
def engagement(spark, sf_dir):
    return adapters.evidence(spark, sf_dir).select("seq", score.engagement_points(F.col("views"), F.col("age")).alias("points"))


def _scored_events(spark, sf_dir):
    e = adapters.evidence(spark, sf_dir)
    extra = adapters.no_extra(view_count=F.col("views"), account_age_days=F.col("age"), content_id_match=F.col("seq") % 4 == 0, fingerprint_match_level=F.when(F.col("seq") % 3 == 0, "confirmed").when(F.col("seq") % 3 == 1, "likely"))
    d = e.select("seq", "platform", "permanent_id", F.lit("").alias("title"), F.lit("").alias("query_used"), F.when(F.col("seq") % 5 == 0, "player.vidio.com").otherwise("").alias("snapshot_html"), extra.alias("extra"), (F.col("seq") % 6).cast("int").alias("prior"))
    return score.scored(d, F.col("prior"), [], RUN_TS)


_SCORE = f"""{EVENTS}, points AS (SELECT seq, CASE WHEN seq % 4 = 0 THEN 30 WHEN seq % 5 = 0 THEN 7 * 1 + CASE WHEN 2 >= 3 THEN 8 ELSE 0 END ELSE 0 END AS watermark, CASE seq % 3 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END AS fingerprint, {_graded_sql('seq % 6', config.REPEAT_GRADES)} AS repeat,
  CASE WHEN views IS NULL OR age IS NULL THEN 0 ELSE {_graded_sql('CAST(views AS DOUBLE) / greatest(age, 1)', config.VIEW_RATE_GRADES)} END AS engagement FROM ev),
total AS (SELECT seq, CAST(least(100, watermark + fingerprint + repeat + engagement) AS INTEGER) AS score FROM points),
judged AS (SELECT seq, score, CASE WHEN score >= 80 THEN 'confirmed' WHEN score >= 60 THEN 'likely' WHEN score >= 25 THEN 'possible' ELSE 'ignore' END AS verdict FROM total)"""


@query(f"WITH {_SCORE} SELECT * FROM judged")
def score_verdict(spark, sf_dir):
    return _scored_events(spark, sf_dir).select("seq", "score", "verdict")


@query(f"WITH {_SCORE} SELECT count(*) FILTER (verdict = 'confirmed') AS confirmed_count, count(*) FILTER (verdict = 'likely') AS likely_count, count(*) FILTER (verdict = 'possible') AS possible_count, count(*) FILTER (verdict = 'ignore') AS ignored_count FROM judged")
def verdict_counts(spark, sf_dir):
    return score.verdict_counts(_scored_events(spark, sf_dir))


@query(f"WITH {DOCS}, p AS (SELECT channel_id, count(*) FILTER (length(title) < 20) AS prior FROM docs GROUP BY 1) SELECT seq, CAST({_graded_sql('coalesce(prior, 0)', config.REPEAT_GRADES)} AS INTEGER) AS score FROM docs LEFT JOIN p USING (channel_id)")
def batch_score(spark, sf_dir):
    d = identity.with_fallback(adapters.documents(spark, sf_dir).withColumn("snapshot_html", F.lit("")), RUN_TS)
    prior = d.groupBy(F.col("channel_id").alias("permanent_id")).agg(F.count_if(F.length("title") < 20).alias("prior"))
    return score.batch_score(d, prior, RUN_TS).select("seq", "score")


# Registry and tables ----------------------------------------------------------------------------------------


def _registry(spark, sf_dir, upto: int | None = None, since: int | None = None):
    """The registry after all evidence, or after two runs split at a number."""
    e = adapters.evidence(spark, sf_dir)
    if upto is None:
        return registry.upsert(registry.empty(spark), e)
    first = registry.upsert(registry.empty(spark), e.filter(F.col("seq") % 10 < upto))
    return registry.upsert(first, e.filter(F.col("seq") % 10 >= upto))


def _tier_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN '{name}'" for least, name in config.TIERS) + f" ELSE '{config.LAST_TIER}' END"


_REGISTRY = f"""{EVENTS}, o AS (SELECT *, CASE WHEN seq % 10 < 4 THEN 0 ELSE 1 END AS run FROM ev),
u AS (SELECT platform, permanent_id, url, min((run, seq)) AS place FROM o GROUP BY ALL),
reg AS (SELECT platform, permanent_id, arg_max(display_name, (run, seq)) AS display_name, arg_max(profile_url, (run, seq)) AS profile_url, {_tier_sql("count(*)")} AS tier, 'active' AS status, CAST(count(*) AS INTEGER) AS violation_count,
  arg_min(detected_at, (run, seq)) AS first_seen, max(detected_at) AS last_seen, '' AS notes FROM o GROUP BY platform, permanent_id),
links AS (SELECT platform, permanent_id, string_agg(url, ' ' ORDER BY place) AS evidence FROM u GROUP BY ALL)"""


@query(f"WITH {_REGISTRY} SELECT reg.*, evidence FROM reg JOIN links USING (platform, permanent_id)")
def registry_upsert(spark, sf_dir):
    return _registry(spark, sf_dir, 4).withColumn("evidence", F.array_join("evidence_urls", " ")).drop("evidence_urls")


@query(f"WITH {_REGISTRY} SELECT tier, count(*) AS offenders, CAST(sum(violation_count) AS BIGINT) AS violations FROM reg GROUP BY tier")
def registry_tiers(spark, sf_dir):
    return _registry(spark, sf_dir, 4).groupBy("tier").agg(F.count("*").alias("offenders"), F.sum("violation_count").alias("violations"))


@query(f"WITH {_REGISTRY} SELECT platform, permanent_id, last_seen FROM reg WHERE platform = 'view' AND permanent_id <> '7'")
def list_active(spark, sf_dir):
    held = registry.update_status(_registry(spark, sf_dir, 4), "view", "7", "suspended", RUN_TS)
    return registry.list_active(held, "view").select("platform", "permanent_id", "last_seen")


@query(f"WITH {_REGISTRY} SELECT platform, permanent_id, CASE WHEN platform = 'view' AND permanent_id = '7' THEN 'suspended' ELSE 'active' END AS status, CASE WHEN platform = 'view' AND permanent_id = '7' THEN '[{RUN_TS}] active → suspended' ELSE '' END AS notes FROM reg")
def update_status(spark, sf_dir):
    held = registry.update_status(_registry(spark, sf_dir, 4), "view", "7", "suspended", RUN_TS)
    return registry.update_status(held, "view", "7", "suspended", "later").select("platform", "permanent_id", "status", "notes")


@query(f"WITH {_REGISTRY} SELECT platform, permanent_id, violation_count AS prior FROM reg WHERE NOT (platform = 'view' AND permanent_id = '7')")
def prior_violations(spark, sf_dir):
    return registry.prior_violations(registry.update_status(_registry(spark, sf_dir, 4), "view", "7", "removed", RUN_TS))


@query(f"""WITH {_REGISTRY} SELECT permanent_id, platform, tier, violation_count, len(string_split(evidence, ' ')) AS evidence_count FROM reg JOIN links USING (platform, permanent_id) WHERE permanent_id = '7' ORDER BY platform LIMIT 1""")
def legal_export(spark, sf_dir):
    package = registry.export_for_legal(_registry(spark, sf_dir, 4), "7")
    shape = "permanent_id string, platform string, tier string, violation_count int, evidence_count bigint"
    return package.select(F.from_json("package", shape).alias("p")).select("p.*")


@query(f"WITH {_REGISTRY} SELECT platform, permanent_id, status, violation_count, tier FROM reg")
def registry_round_trip(spark, sf_dir):
    return registry.from_rows(registry.to_rows(_registry(spark, sf_dir, 4))).select("platform", "permanent_id", "status", "violation_count", "tier")


@query(f"WITH {_REGISTRY} SELECT platform, permanent_id, violation_count, tier FROM reg WHERE platform = 'click' AND permanent_id = (SELECT min(permanent_id) FROM reg WHERE platform = 'click')")
def registry_lookup(spark, sf_dir):
    held = _registry(spark, sf_dir, 4)
    first = held.filter("platform = 'click'").agg(F.min("permanent_id")).first()[0]
    return registry.lookup(held, "click", first or "").select("platform", "permanent_id", "violation_count", "tier")


@query("""SELECT event_type AS platform, CAST(user_id AS VARCHAR) AS permanent_id, CAST(floor(arg_max(value, event_id) * 10) AS INTEGER) AS violation_count, 'active' AS status FROM events GROUP BY ALL""")
def registry_refresh(spark, sf_dir):
    """Table rows that repeat a key: the last one counts, and an empty status is active."""
    e = adapters.table(spark, sf_dir, "events")
    known = {"permanent_id": F.col("user_id").cast("string"), "platform": F.col("event_type"), "violation_count": F.floor(F.col("value") * 10).cast("int").cast("string"), "status": F.lit("")}
    rows = e.select(*(known.get(c, F.lit("x")).alias(c) for c in schemas.names(schemas.REGISTRY_TABLE)), F.col("event_id").alias("sheet_row"))
    return registry.from_rows(rows).select("platform", "permanent_id", "violation_count", "status")


@query(
    f"""WITH {_REGISTRY}, a AS (SELECT * FROM reg WHERE platform <> 'view'), b AS (SELECT * FROM reg WHERE platform <> 'click')
    SELECT platform, permanent_id, 'later' AS notes, violation_count FROM b UNION ALL SELECT platform, permanent_id, notes, violation_count FROM a WHERE (platform, permanent_id) NOT IN (SELECT (platform, permanent_id) FROM b)"""
)
def offenders_merge(spark, sf_dir):
    held = _registry(spark, sf_dir, 4)
    return tables.merge_offenders(held.filter("platform <> 'view'"), held.filter("platform <> 'click'").withColumn("notes", F.lit("later"))).select("platform", "permanent_id", "notes", "violation_count")


@query(f"WITH {DOCS} SELECT 'c' || seq AS cluster_id, CASE WHEN seq = (SELECT min(seq) FROM docs) THEN 'taken_down' ELSE 'new' END AS status, CASE WHEN seq = (SELECT min(seq) FROM docs) THEN 'by hand' ELSE '' END AS notes FROM docs")
def detection_status(spark, sf_dir):
    base = adapters.documents(spark, sf_dir)
    first = base.agg(F.min("seq")).first()[0]
    rows = tables.detection_rows(base.withColumns({"cluster_id": F.concat(F.lit("c"), F.col("seq").cast("string")), "identity": F.struct(*(F.lit("").alias(c) for c in ("platform", "permanent_id", "display_name", "profile_url"))), "score": F.lit(1), "verdict": F.lit("possible")}))
    return tables.update_detection_status(rows, f"c{first}", "taken_down", "by hand").select("cluster_id", "status", "notes")


@query(
    f"""WITH {_REGISTRY} SELECT seq, violation_count, tier, 'new' AS status FROM ev JOIN reg USING (platform, permanent_id)"""
)
def detections_with_offenders(spark, sf_dir):
    """Rows of the detections table get tier and count of their offender."""
    e = adapters.evidence(spark, sf_dir).withColumns({"cluster_id": F.col("seq").cast("string"), "title": F.lit(""), "score": F.lit(90), "verdict": F.lit("confirmed"), "identity": F.struct("platform", "permanent_id", "display_name", "profile_url")})
    return tables.detection_rows(e, _registry(spark, sf_dir, 4)).select(F.col("cluster_id").cast("bigint").alias("seq"), "violation_count", "tier", "status")


_TABLE_COLUMNS = "cluster_id, content_title, score, verdict, status, first_detected, last_detected"


@query(
    f"""WITH {DOCS}, r AS (SELECT 'c' || seq AS cluster_id, title AS content_title, CAST(seq % 100 AS INTEGER) AS score, detected_at, seq, {_IN_OLD} AS was, {_IN_NEW} AS came FROM docs)
    SELECT a.cluster_id, CASE WHEN b.cluster_id IS NOT NULL AND a.seq % 4 <> 0 THEN 'new ' || a.content_title ELSE a.content_title END AS content_title, CASE WHEN b.cluster_id IS NOT NULL THEN 100 - a.score ELSE a.score END AS score, CASE WHEN b.cluster_id IS NOT NULL THEN 'likely' ELSE 'possible' END AS verdict,
    'reviewed' AS status, a.detected_at AS first_detected, CASE WHEN b.cluster_id IS NOT NULL THEN 'later' ELSE a.detected_at END AS last_detected FROM r a LEFT JOIN r b ON a.cluster_id = b.cluster_id AND b.came WHERE a.was
    UNION ALL SELECT cluster_id, CASE WHEN seq % 4 <> 0 THEN 'new ' || content_title ELSE '' END, 100 - score, 'likely', 'new', 'later', 'later' FROM r WHERE came AND NOT was"""
)
def detections_merge(spark, sf_dir):
    old, again = _detection_batches(spark, sf_dir)
    return tables.merge_detections(old, again).select(*_TABLE_COLUMNS.split(", "))


def _detection_batches(spark, sf_dir):
    n = F.col("seq")
    base = adapters.documents(spark, sf_dir).withColumns({"cluster_id": F.concat(F.lit("c"), n.cast("string")), "identity": F.struct(*(F.lit("").alias(c) for c in ("platform", "permanent_id", "display_name", "profile_url"))), "score": (n % 100).cast("int"), "verdict": F.lit("possible")})
    old = tables.detection_rows(base.filter(_IN_OLD)).withColumn("status", F.lit("reviewed"))
    again = base.filter(_IN_NEW).withColumns({"title": F.when(n % 4 != 0, F.concat(F.lit("new "), "title")).otherwise(""), "score": (100 - n % 100).cast("int"), "verdict": F.lit("likely"), "detected_at": F.lit("later")})
    return old, tables.detection_rows(again)


@query(SQL["detections_merge"])
def detections_merge_buckets(spark, sf_dir):
    """The same merge into a table in buckets, which rewrites only those the second batch meets."""
    table = BucketTable(spark, scratch_path(spark, "bucket-table"), schemas.DETECTIONS_TABLE, ["cluster_id"])
    for batch in _detection_batches(spark, sf_dir):
        table.merge(batch, tables.merge_detections)
    return table.read().select(*_TABLE_COLUMNS.split(", "))


def _stats(spark, sf_dir):
    """Run statistics per language, as many runs."""
    d = adapters.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").cast("int").alias("detections_raw"), F.count_distinct("source").cast("int").alias("clusters_after_dedup"), F.count_if(F.col("n_chars") > 3000).cast("int").alias("confirmed_count")).select(
        "lang", "detections_raw", "clusters_after_dedup", "confirmed_count", *(F.lit(0).alias(c) for c in ("likely_count", "possible_count", "ignored_count", "sheet_write_errors")),
        F.array().cast("array<string>").alias("errors"), F.array(F.lit("facebook")).alias("platforms_crawled"), (F.col("detections_raw") * 10).cast("double").alias("duration_seconds"),
    )


@query(
    """WITH s AS (SELECT lang, count(*) AS raw, count(DISTINCT source) AS kept, count(*) FILTER (n_chars > 3000) AS confirmed FROM documents GROUP BY lang),
    c AS (SELECT 0 AS position, 'zero_detections' AS name, 'ok' AS status FROM s UNION ALL SELECT 1, 'sheet_write_errors', 'ok' FROM s
      UNION ALL SELECT 2, 'dedup_ratio', CASE WHEN (raw - kept) / raw < 0.1 OR (raw - kept) / raw > 0.7 THEN 'degraded' ELSE 'ok' END FROM s
      UNION ALL SELECT 3, 'score_distribution', CASE WHEN confirmed = 0 THEN 'degraded' ELSE 'ok' END FROM s UNION ALL SELECT 4, 'runtime', CASE WHEN raw * 10 > 3600 THEN 'degraded' ELSE 'ok' END FROM s)
    SELECT position, name, status, count(*) AS runs FROM c GROUP BY ALL"""
)
def health_checks(spark, sf_dir):
    return health.checks(_stats(spark, sf_dir)).groupBy("position", "name", "status").agg(F.count("*").alias("runs"))


@query("""WITH s AS (SELECT lang, count(*) AS raw, count(DISTINCT source) AS kept, count(*) FILTER (n_chars > 3000) AS confirmed FROM documents GROUP BY lang)
    SELECT CASE WHEN bool_or((raw - kept) / raw < 0.1 OR (raw - kept) / raw > 0.7 OR confirmed = 0 OR raw * 10 > 3600) THEN 'degraded' ELSE 'healthy' END AS overall_status FROM s""")
def overall_status(spark, sf_dir):
    return health.overall(health.checks(_stats(spark, sf_dir)))


_CHANNEL_RUNS = """s AS (SELECT lang, source, count(*) FILTER (n_chars > 3000) AS raw, count(DISTINCT doc_id % 4) FILTER (n_chars > 3000) AS kept, count(*) FILTER (n_chars > 8000) AS confirmed, count(*) FILTER (n_chars < 300) AS failed FROM documents GROUP BY lang, source),
    c AS (SELECT lang, source, 0 AS position, CASE WHEN raw = 0 THEN 'critical' ELSE 'ok' END AS status FROM s UNION ALL SELECT lang, source, 1, CASE WHEN failed > 0 THEN 'critical' ELSE 'ok' END FROM s
      UNION ALL SELECT lang, source, 2, CASE WHEN raw = 0 THEN 'skipped' WHEN (raw - kept) / raw < 0.1 OR (raw - kept) / raw > 0.7 THEN 'degraded' ELSE 'ok' END FROM s
      UNION ALL SELECT lang, source, 3, CASE WHEN raw = 0 THEN 'skipped' WHEN confirmed = 0 THEN 'degraded' ELSE 'ok' END FROM s UNION ALL SELECT lang, source, 4, CASE WHEN raw * 100 > 3600 THEN 'degraded' ELSE 'ok' END FROM s)"""


def _channel_stats(spark, sf_dir):
    """Run statistics per channel, long documents as detections and short ones as failed writes: some runs find nothing."""
    d, long = adapters.table(spark, sf_dir, "documents"), F.col("n_chars") > 3000
    return d.groupBy("lang", "source").agg(
        F.count_if(long).cast("int").alias("detections_raw"), F.count_distinct(F.when(long, F.col("doc_id") % 4)).cast("int").alias("clusters_after_dedup"),
        F.count_if(F.col("n_chars") > 8000).cast("int").alias("confirmed_count"), F.count_if(F.col("n_chars") < 300).cast("int").alias("sheet_write_errors"),
    ).withColumns({c: F.lit(0) for c in ("likely_count", "possible_count", "ignored_count")} | {"duration_seconds": (F.col("detections_raw") * 100).cast("double")})


@query(f"WITH {_CHANNEL_RUNS} SELECT position, status, count(*) AS runs FROM c GROUP BY ALL")
def health_of_channels(spark, sf_dir):
    """All branches of the checks: runs without detections and runs with failed writes among them."""
    return health.checks(_channel_stats(spark, sf_dir)).groupBy("position", "status").agg(F.count("*").alias("runs"))


@query(f"WITH {_CHANNEL_RUNS} SELECT CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall_status FROM c")
def overall_of_channels(spark, sf_dir):
    return health.overall(health.checks(_channel_stats(spark, sf_dir)))


@query("SELECT 'run-' || lang AS run_id, 90.5::DOUBLE AS duration_seconds, CAST(count(*) AS INTEGER) AS detections_found, 'facebook' AS platforms_crawled FROM documents GROUP BY lang")
def run_log(spark, sf_dir):
    row = tables.run_log_row(_stats(spark, sf_dir), F.concat(F.lit("run-"), "lang"), "2026-01-01T00:00:00Z", "2026-01-01T00:01:30.5Z")
    return row.select("run_id", "duration_seconds", "detections_found", "platforms_crawled")


# Whole runs -------------------------------------------------------------------------------------------------


@query(
    f"""WITH {PAGES}, p AS (SELECT *, {url_sql('url')} AS canon FROM pgs), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY canon ORDER BY length(snapshot_html) DESC, detected_at, seq) = 1),
    m AS (SELECT channel_id, CASE WHEN contains(lower(snapshot_html), 'vidio.com') THEN 7 ELSE 0 END AS points FROM b)
    SELECT channel_id, count(*) AS videos, count(*) FILTER (points > 0) AS marked FROM m GROUP BY channel_id"""
)
def flagship(spark, sf_dir):
    """Which hosts serve the most distinct pages, and how many carry a brand marker."""
    d = adapters.pages(spark, sf_dir).withColumn("canonical", urls.canonical_url(F.col("url")))
    best = cluster.pick_canonical(d, ["canonical"])
    points = score.watermark_points(F.col("extra.content_id_match"), F.col("snapshot_html"))
    return best.groupBy("channel_id").agg(F.count("*").alias("videos"), F.count_if(points > 0).alias("marked"))


_MARKERS_SQL = " + ".join(f"CAST(contains(lower(snapshot_html), '{m.lower()}') AS INTEGER)" for m in config.BRAND_MARKERS)
#: Names of the similarity's steps serve once in a query: titles against the catalog get names of their own.
_RUN_POINTS = re.sub(r"\b(sorted_words|shared|spelled|masked|matched|compared)\b", r"catalog_\1", _TITLE_POINTS)
_VERDICT_SQL = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for name, least in config.VERDICTS) + " ELSE 'ignore' END"


@query(
    f"""WITH RECURSIVE {_components_sql(DOCS.replace('FROM documents)', f'FROM documents WHERE source NOT IN ({listed(WHITELIST)}))'), fuzzy=True)}, {_RANKED}, {_RUN_POINTS},
    scored AS (SELECT *, CAST(CASE WHEN trim(title) = '' THEN 0 ELSE coalesce(points, 0) END + {_graded_sql('(' + _MARKERS_SQL + ')', config.MARKER_GRADES)} AS INTEGER) AS score FROM ranked LEFT JOIN title_points ON t1 = {canonical_sql('title')} WHERE place = 1)
    SELECT {_CLUSTER_ID_SQL} AS cluster_id, seq, CAST(n AS INTEGER) AS cluster_size, score, {_VERDICT_SQL} AS verdict FROM scored"""
)
def run_documents(spark, sf_dir):
    """The whole run over documents: score, verdict and cluster of each canonical detection."""
    listed_channels = spark.createDataFrame([(c,) for c in WHITELIST], "channel_id string")
    done = run.run(adapters.documents(spark, sf_dir), listed_channels, adapters.titles(spark, sf_dir), RUN_TS)
    return done.evidence.select("cluster_id", "seq", "cluster_size", "score", "verdict")


@query(f"WITH RECURSIVE {_COMPONENTS.replace('FROM documents)', f'FROM documents WHERE source NOT IN ({listed(WHITELIST)}))')} SELECT (SELECT CAST(count(*) AS INTEGER) FROM documents) AS detections_raw, CAST(count(DISTINCT component) AS INTEGER) AS clusters_after_dedup, CAST(count(DISTINCT component) AS INTEGER) AS ignored_count FROM parts")
def run_stats(spark, sf_dir):
    from uploadwatch.config import Settings

    listed_channels = spark.createDataFrame([(c,) for c in WHITELIST], "channel_id string")
    done = run.run(adapters.documents(spark, sf_dir), listed_channels, [], RUN_TS, settings=Settings(fuzzy_threshold=None), dry_run=True)
    return done.stats.select("detections_raw", "clusters_after_dedup", "ignored_count")


