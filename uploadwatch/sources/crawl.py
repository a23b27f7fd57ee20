"""Detections from crawled pages.

Fetching is outside the engine: a crawler delivers pages (query, html, seq), or cards read from a page's
DOM.  A platform is a function from pages to rows of ``FOUND``; the registry of platforms is open.  A row with a
``failure`` says what went wrong with a page, or with a link of it; the others are detections.  So a page that cannot be read
costs that page, and both kinds of rows are written in one pass.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uploadwatch import config, schemas
from uploadwatch.functions import pages, urls
from uploadwatch.functions.text import duration_seconds
from uploadwatch.operators.ordinals import numbered
from uploadwatch.scratch import materialize

CARDS = "query string, page_seq bigint, pos int, url string, video_id string, title string, channel_id string, channel_name string, views string, duration string, failure string"
#: A place orders detections: by page, then within it.
FOUND = schemas.DETECTION.removesuffix(", seq bigint") + ", place struct<page_seq:bigint,pos:int>, failure string"
ERRORS = "platform string, query string, page_seq bigint, message string"
NO_PAGE = "the page has no text"


def social_detections(crawled: DataFrame, run_ts: str, max_results: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A detection for each distinct video address of a result page, in order; data of the page stand in for what its links lack.  keep: further columns of the page that stay."""
    html = F.col("html")
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  worked out once, used in then
    unknown = F.struct(F.lit("unknown").alias("id"), F.lit("").alias("name"))

    def read(url: Column) -> Column:
        def settled(video: Column, place: Column, near: Column, page: Column, owner: Column, data: Column) -> Column:
            channel = F.when(page.isNotNull(), urls.channel_of_page(page)).otherwise(owner["id"])
            snapshot = F.coalesce(F.substring(html, F.greatest(F.lit(1), place - 199), place + 1500 - F.greatest(F.lit(0), place - 200)), F.lit(""))
            title = F.when((near == "") & video.isNotNull(), pages.title_in(data)).otherwise(near)
            return F.struct(url.alias("url"), title.alias("title"), channel.alias("channel_id"), owner["name"].alias("channel_name"), snapshot.alias("snapshot_html"), pages.views_near(html, place).alias("views"))

        def owned(video: Column, place: Column, near: Column, page: Column, data: Column) -> Column:
            owner = F.when(page.isNull() & video.isNotNull(), pages.channel_in(data, video)).otherwise(unknown)
            return bound(owner, lambda found: settled(video, place, near, page, found, data))

        # The data are looked for only where the link lacks something.
        data = lambda video, near, page: F.when(((near == "") | page.isNull()) & video.isNotNull(), pages.data_of(html, video))
        paged = lambda video, place, near: bound(pages.page_url_near(html, place), lambda page: bound(data(video, near, page), lambda held: owned(video, place, near, page, held)))
        titled = lambda video, place: bound(pages.title_near(html, place), lambda near: paged(video, place, near))
        return bound(urls.video_id(url), lambda video: bound(pages.link_place(html, url, video), lambda place: titled(video, place)))

    # All is read from the page before its links become rows, so rows do not carry pages.
    found = crawled.select("query", F.col("seq").alias("page_seq"), *keep, html.isNull().alias("_missing"), F.posexplode_outer(F.transform(pages.video_urls(html), read)).alias("pos", "r")).filter("_missing or r is not null")
    if max_results is not None:
        found = found.filter(F.col("_missing") | (F.col("pos") < max_results))
    extra = F.struct(F.col("r.views").alias("view_count"), *(F.lit(None).cast(t).alias(n) for n, t in (("duration_secs", "int"), ("content_id_match", "boolean"), ("fingerprint_match_level", "string"), ("account_age_days", "int"))))
    return found.select(
        F.lit("facebook").alias("platform"), *(F.col(f"r.{c}").alias(c) for c in ("url", "title", "channel_id", "channel_name", "snapshot_html")),
        F.lit(run_ts).alias("detected_at"), F.col("query").alias("query_used"), extra.alias("extra"), F.struct("page_seq", "pos").alias("place"), F.when(F.col("_missing"), NO_PAGE).alias("failure"), *keep,
    )


def card_detections(cards: DataFrame, run_ts: str, least_seconds: int = config.LEAST_DURATION, max_results: int | None = None) -> DataFrame:
    """Detections of video cards; those known to be shorter than least_seconds are left out."""
    cards = cards if "failure" in cards.columns else cards.withColumn("failure", F.lit(None).cast("string"))
    timed = cards.withColumn("secs", duration_seconds(F.col("duration"))).filter(F.col("secs").isNull() | (F.col("secs") >= least_seconds))
    if max_results is not None:
        told = F.col("failure").isNotNull()
        timed = timed.withColumn("_n", F.row_number().over(Window.partitionBy("query", "page_seq", told).orderBy("pos"))).filter(told | (F.col("_n") <= max_results))
    extra = F.struct(
        pages.card_views(F.col("views")).alias("view_count"), F.col("secs").alias("duration_secs"), F.lit(None).cast("boolean").alias("content_id_match"), F.lit(None).cast("string").alias("fingerprint_match_level"), F.lit(None).cast("int").alias("account_age_days")
    )
    return timed.select(
        F.lit("bilibili").alias("platform"), "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("channel_id", F.lit("unknown")).alias("channel_id"), F.coalesce("channel_name", F.lit("")).alias("channel_name"),
        F.lit("").alias("snapshot_html"), F.lit(run_ts).alias("detected_at"), F.col("query").alias("query_used"), extra.alias("extra"), F.struct("page_seq", "pos").alias("place"), "failure",
    )


class _Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: _Node | None):
        self.tag, self.attributes, self.parent, self.children, self.said = tag, attributes, parent, [], []

    def walk(self) -> Iterator[_Node]:
        """All nodes below, in order of the text; by a stack, as unclosed tags nest without end."""
        todo = self.children[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.children[::-1]

    def text(self) -> str:
        parts, todo = [], self.said[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                todo += x.said[::-1]
        return "".join(parts)

    def classed(self, *parts: str) -> bool:
        return any(p in self.attributes.get("class", "") for p in parts)


class _Tree(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.said.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.said.append(data)


# Class names of a card and of its parts, the channel's in order of preference.
_CARD, _TITLE = "bstar-video-card", ("bstar-video-card__title", "bstar-video-card__name")
_CHANNEL = ("bstar-video-card__up", "up-name", "uploader", "author", "owner", "creator", "user-name", "username")
_CHANNEL_LINKS = ("/space/", "/@", "/user/")
_VIEWS = ("bstar-video-card__stat", "view", "play", "count")
_DURATION = ("duration", "bstar-video-card__duration", "bstar-play-progress")


def _address(base: str, href: str, failures: list[str]) -> str:
    """The absolute address, or nothing and a failure where there is none."""
    try:
        return urljoin(base, href)
    except ValueError as e:
        failures.append(f"link {href[:80]!r}: {e}")
        return ""


def read_cards(html: str, base: str = "https://www.bilibili.tv/", failures: list[str] | None = None) -> list[dict]:
    """Video cards of a page, once per video, in order; links that are no address are left out and named in failures."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    cards: dict[str, dict] = {}
    failures = [] if failures is None else failures
    for link in (n for n in tree.root.walk() if n.tag == "a" and "href" in n.attributes):
        address = _address(base, link.attributes["href"].strip(), failures)
        number = re.search(r"/video/([0-9]{10,})", address)
        if "bilibili.tv" not in address or not number or number[1] in cards:
            continue
        card = link
        while card is not None and not card.classed(_CARD):
            card = card.parent
        card = card or link.parent
        inside = list(card.walk())
        first = lambda test: next((n for n in inside if test(n)), None)
        said = lambda node: node.text().strip() if node else ""
        cover = next((n for n in link.walk() if n.tag == "img"), None)
        title = (cover.attributes.get("alt", "") if cover else "") or said(first(lambda n: n.classed(*_TITLE)))
        options = [first(lambda n, c=c: n.classed(c)) for c in _CHANNEL] + [first(lambda n, p=p: n.tag == "a" and p in n.attributes.get("href", "")) for p in _CHANNEL_LINKS]
        channel = next((n for n in options if n), None)
        home = _address(base, channel.attributes["href"], failures) if channel and "href" in channel.attributes else ""
        owner = next((m for m in (re.search(rf"{p}([\w.-]+)", home, re.A) for p in _CHANNEL_LINKS) if m), None) if home else None
        cards[number[1]] = {
            "url": f"https://www.bilibili.tv/video/{number[1]}", "video_id": number[1], "title": title[:200], "channel_id": owner[1] if owner else f"bilibili_{number[1]}", "channel_name": said(channel),
            "views": said(first(lambda n: n.classed(*_VIEWS))), "duration": said(first(lambda n: n.classed(*_DURATION))),
        }
    return list(cards.values())


def cards_of_pages(crawled: DataFrame) -> DataFrame:
    """Cards need nesting, which regular expressions cannot see: pages are parsed in Arrow batches, each page for itself.

    What a page or a link of it failed at stands in rows of its own, which have query, page and failure only.
    """

    def read(html: str | None) -> tuple[list[dict], list[str]]:
        failures = [] if html is not None else [NO_PAGE]
        try:
            return read_cards(html or "", failures=failures), failures
        except Exception as e:  # whatever a page holds must not end the others
            return [], [*failures, f"{type(e).__name__}: {e}"[:200]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schemas.names(CARDS)
        for batch in batches:
            rows = []
            for query, html, seq in zip(*(c.to_pylist() for c in batch.columns)):
                cards, failures = read(html)
                rows += [{"query": query, "page_seq": seq, "pos": k} | card for k, card in enumerate(cards)]
                rows += [{"query": query, "page_seq": seq, "failure": said} for said in failures]
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return crawled.select("query", "html", "seq").mapInArrow(run, CARDS)


def bilibili_detections(crawled: DataFrame, run_ts: str, max_results: int | None = None) -> DataFrame:
    return card_detections(cards_of_pages(crawled), run_ts, max_results=max_results)


PLATFORMS: dict[str, Callable[..., DataFrame]] = {"facebook": social_detections, "bilibili": bilibili_detections}


def enabled_platforms(asked: list[str] | None = None, env: dict[str, str] | None = None) -> list[str]:
    """Asked for, else listed in ENABLED_PLATFORMS, else the first; unknown ones are skipped with a warning."""
    given = asked or [p.strip() for p in (env if env is not None else os.environ).get("ENABLED_PLATFORMS", "facebook").split(",") if p.strip()]
    for p in given:
        if p not in PLATFORMS:
            warnings.warn(f"unknown platform {p!r} is skipped", stacklevel=2)
    return [p for p in given if p in PLATFORMS]


def _said(e: Exception) -> str:
    """What an exception says of its cause: the line that names one, of an executor's trace the last."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    named = [x for x in lines if re.match(r"[\w.]*(Error|Exception)\b\s*:", x)]
    return named[-1] if named and len(lines) > 1 else f"{type(e).__name__}: {lines[0] if lines else ''}"


def _extracted(platform: str, crawled: DataFrame, run_ts: str, max_results: int | None) -> tuple[list[DataFrame], list[tuple]]:
    """Rows of a platform, written, and its queries that end in an exception.

    If all queries at once fail, each half is tried for itself, and so on: the queries at fault are found by a number
    of runs that grows with the logarithm of the queries, and all others keep their detections.
    """
    try:
        found = PLATFORMS[platform](crawled, run_ts, max_results=max_results)
        if "failure" not in found.columns:
            found = found.withColumn("failure", F.lit(None).cast("string"))
        return [materialize(found.select(*schemas.names(FOUND.replace(schemas.EXTRA, "x").replace("struct<page_seq:bigint,pos:int>", "x"))), "crawled")], []
    except Exception as e:  # whatever a platform's pages do must not end the run
        key = F.xxhash64("query")
        bounds = crawled.agg(F.min(key), F.max(key)).first()
        if bounds[0] is None or bounds[0] == bounds[1]:
            query = crawled.select("query").first()
            return [], [(platform, query and query["query"], _said(e)[:200])]
        # Between the least and the greatest hash there is a query on either side of their middle.
        middle = (bounds[0] + bounds[1]) // 2
        halves = [_extracted(platform, crawled.filter(rule), run_ts, max_results) for rule in (key <= F.lit(middle), key > F.lit(middle))]
        return [f for found, _ in halves for f in found], [x for _, failed in halves for x in failed]


def crawl(crawled: dict[str, DataFrame], run_ts: str, platforms: list[str] | None = None, max_results: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """Detections of all enabled platforms whose pages are given, and errors (``ERRORS``).

    seq numbers detections by platform, page and place.  An error names the page it cost, or all pages of a query (no page_seq)
    where a platform's extraction ended in an exception.
    """
    spark = next(iter(crawled.values())).sparkSession
    rows = spark.createDataFrame([], FOUND).withColumn("_order", F.lit(0))
    failed: list[tuple] = []
    for k, p in enumerate(enabled_platforms(platforms)):
        if p in crawled:
            found, own = _extracted(p, crawled[p], run_ts, max_results)
            failed += own
            for f in found:
                rows = rows.unionByName(f.withColumn("_order", F.lit(k)))
    good = numbered(rows.filter("failure is null"), [F.col("_order"), F.col("place")], "seq").drop("_order", "place", "failure")
    lost = rows.filter("failure is not null").select("platform", F.col("query_used").alias("query"), F.col("place.page_seq").alias("page_seq"), F.col("failure").alias("message"))
    ended = spark.createDataFrame([(p, q, None, m) for p, q, m in failed], ERRORS)  # at most a row per query
    return good, lost.unionByName(ended)


def crawl_all(crawled: dict[str, DataFrame], run_ts: str, platforms: list[str] | None = None, max_results: int | None = 50, errors: list[str] | None = None) -> DataFrame:
    """The detections of ``crawl``.  Each platform and query with errors is warned of and named in errors, with how many there are and one of them."""
    found, lost = crawl(crawled, run_ts, platforms, max_results)
    by_query = lost.groupBy("platform", "query").agg(F.count("*").alias("n"), F.min("message").alias("message")).orderBy("platform", "query")
    for r in by_query.collect():  # a row per platform and query of the run
        said = f"{r['platform']}, query {r['query']!r}: {r['message']}" + (f" and {r['n'] - 1} more" if r["n"] > 1 else "")
        warnings.warn(f"left out: {said}", stacklevel=2)
        if errors is not None:
            errors.append(said)
    return found
