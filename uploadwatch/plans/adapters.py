"""The generic tables seen as detections, pages, evidence and titles, by fixed projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uploadwatch import schemas

RUN_TS = "2026-01-01T00:00:00Z"
_START = 1_767_225_600  # 2026-01-01 in seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(_START) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def no_extra(**known: Column) -> Column:
    kinds = dict(part.split(":") for part in schemas.EXTRA[7:-1].split(","))
    return F.struct(*(known.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection per document: language as platform, source as channel, first line as title; of five, the second shares the first's video."""
    d = table(spark, sf_dir, "documents")
    number = F.when(F.col("doc_id") % 5 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return d.select(
        F.col("lang").alias("platform"), F.concat(F.lit("https://m.facebook.com/watch?v="), number.cast("string"), F.when(F.col("doc_id") % 2 == 0, "&utm_source=x").otherwise("")).alias("url"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"), F.col("source").alias("channel_id"), F.concat(F.lit("Channel "), "source").alias("channel_name"), F.col("text").alias("snapshot_html"),
        stamp(F.col("doc_id")).alias("detected_at"), F.lit("").alias("query_used"), no_extra().alias("extra"), F.col("doc_id").alias("seq"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection per web page: host as channel, document title as title."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.lit("web").alias("platform"), "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("channel_id"), F.lit("").alias("channel_name"),
        F.col("html").alias("snapshot_html"), stamp(F.col("page_id")).alias("detected_at"), F.lit("").alias("query_used"), no_extra().alias("extra"), F.col("page_id").alias("seq"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence per event: event type as platform, user as offender, value as views and a number of props as age."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("platform"), F.col("user_id").cast("string").alias("permanent_id"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" #"), (F.col("event_id") % 3).cast("string")).alias("display_name"),
        F.concat(F.lit("https://p.example/"), F.col("user_id").cast("string")).alias("profile_url"), F.concat(F.lit("https://v.example/"), (F.col("event_id") % 7).cast("string")).alias("url"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("detected_at"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 1000).cast("bigint").alias("views"), F.get_json_object("props", "$.k").cast("int").alias("age"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, title: the first four words of benchmark items."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("seq"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page per web page, with two cards of four kinds by its number."""
    n = F.col("page_id")
    text = n.cast("string")
    link = F.element_at(F.array(F.concat(F.lit("/watch?v=9"), text, F.lit("&amp;ref=search")), F.concat(F.lit("/reel/9"), text, F.lit("/")), F.concat(F.lit("/groups/77/videos/9"), text), F.concat(F.lit("https://www.facebook.com/page"), text, F.lit("/videos/9"), text)), (n % 4 + 1).cast("int"))
    owner = F.element_at(F.array(F.concat(F.lit("/profile.php?id=55"), text), F.concat(F.lit("/pages/Media/Some-Page/66000"), text), F.concat(F.lit("/uploader"), text)), (n % 3 + 1).cast("int"))
    views = F.element_at(F.array(F.concat(text, F.lit("K views")), F.lit("1.2M views"), F.concat(text, F.lit(",5 rb Tayangan")), F.lit("no number")), (n % 4 + 1).cast("int"))
    html = F.concat(
        F.lit('<div class="card"><a href="'), link, F.lit('" aria-label="Title of '), text, F.lit('">watch</a><a href="'), owner, F.lit('">by</a><span>'), views, F.lit("</span></div>"), F.repeat(F.lit(" "), 1200),
        F.lit('<div class="card"><a href="/reel/8'), text, F.lit('">r</a><b>Second of '), text, F.lit("</b></div>"),
    )
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("q"), (n % 10).cast("string")).alias("query"), html.alias("html"), n.alias("seq"))
