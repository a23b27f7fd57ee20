"""Benchmark decontamination (4): every occurrence of a benchmark window in a document, exactly.

A prefix-filtered set join.  An item's shingles (five words, or the whole of a shorter item) are ordered by
rarity; a window occurs only where its rarest shingle does, so one shingle per window, the necessary
prefix, is looked up (neighbouring windows mostly share it).  The positions of both sides bound what a match
can cover: each is extended word by word over the windows that chose the shingle, and counts only if a whole
window agrees.  Windows that several items share are looked up once.  DataFrame functions only.

Words are runs of characters other than ASCII punctuation, space and control characters, in lower case for
A-Z.  Hashes are taken over lower(word), which can only unite words; the words themselves decide.

Texts are split once: one generator gives the hashes of all widths, and a row that counts a text's words.
The benchmark side is broadcast in blocks of at most BLOCK shingles, so its size is bounded whatever the
benchmark's; further blocks are further passes.

Cases: null and empty texts have no words; an item without words never occurs; repeated items count once;
an item with a null id marks words but is not listed; rows that share a doc_id are judged each by its text;
further columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.common import row_key
from uploadwatch.scratch import materialize

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE, BLOCK = 10, 5, 200_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingles(words: Column, widths: list[int]) -> Column:
    """Hashes of each width for each position, after a null; the last ones cover fewer words and are settled by comparison.

    Words are bound to a variable: a plain outer reference may be inlined and split the text anew for each word.
    """
    low = F.transform(words, lambda w: F.lower(w))
    one = lambda ws, w, i, k: F.xxhash64(F.lit(k), w, *(F.get(ws, i + j) for j in range(1, k)))
    every = lambda ws: F.transform(ws, lambda w, i: one(ws, w, i, widths[0])) if len(widths) == 1 else F.flatten(F.transform(ws, lambda w, i: F.array(*(one(ws, w, i, k) for k in widths))))
    return F.concat(F.array(F.lit(None).cast("bigint")), F.get(F.transform(F.array(low), every), F.lit(0)))


def anchors(benchmark: DataFrame, window: int = WINDOW, width: int = SHINGLE) -> DataFrame:
    """anchor (a number), hash, width, context (words of the windows that chose the shingle), at (the shingle's place in it), size (of a window), items (that hold the context)."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    items = items.select("item_id", words_of(F.translate("text", UPPER, LOWER)).alias("words"), F.transform(words_of(F.col("text")), lambda w: F.lower(w)).alias("low")).filter("size(words) > 0")
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window))).withColumn("width", F.least(F.size("words"), F.lit(width))).withColumn("_id", F.xxhash64("item_id", "words"))
    hashes = F.get(F.transform(F.array("low"), lambda ws: F.transform(ws, lambda w, i: F.xxhash64(F.array_join(F.slice(ws, i + 1, F.col("width")), " ")))), F.lit(0))
    # The benchmark's own counts order the shingles; any order common to all windows is right.
    placed = items.select("_id", F.size("words").alias("n"), "size", "width", F.posexplode(hashes).alias("p", "rough")).filter("p <= n - width")
    rarity = placed.groupBy("rough").agg(F.count_distinct("_id").alias("items"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - (F.col("size") - F.col("width"))), F.least(F.col("p"), F.col("n") - F.col("size")))
    windows = placed.join(rarity, "rough").select("_id", "p", "items", "rough", F.explode(starts).alias("start"))
    chosen = windows.groupBy("_id", "start").agg(F.min_by("p", F.struct("items", "rough", "p")).alias("p"))
    # Windows that choose one shingle follow each other: what is least in two of them is least between them.
    runs = chosen.groupBy("_id", "p").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    exact = runs.join(items, "_id").select("item_id", "size", "width", (F.col("p") - F.col("first")).alias("at"), F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("size")).alias("context"), F.slice("low", F.col("p") + 1, F.col("width")).alias("key"))
    shared = exact.groupBy("size", "width", "at", "context", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    by_width = [F.when(F.col("width") == k, F.xxhash64(F.lit(k), *(F.get("key", F.lit(i)) for i in range(k)))) for k in range(1, width + 1)]
    return shared.select(F.monotonically_increasing_id().alias("anchor"), F.coalesce(*by_width).alias("hash"), "width", "context", "at", "size", "items")


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """doc_id, _key (of the row's text), anchor, items, first, past: word intervals that windows cover; and doc_id, _key, n_words of every row."""
    found = materialize(anchors(benchmark, window, width), "anchors")
    sizes = {r["width"]: r["n"] for r in found.groupBy("width").agg(F.count("*").alias("n")).collect()}
    widths = sorted(sizes) or [width]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    words = texts.select("doc_id", row_key().alias("_key"), words_of(F.col("text")).alias("words"))
    # Over a plain column the generator is compiled, so words are not copied for each position; an outer one
    # infers no filter on the size of the hashes, for which they would be worked out twice.
    listed = words.withColumn("hashes", _shingles(F.col("words"), widths)).select("doc_id", "_key", "words", F.posexplode_outer("hashes").alias("p", "hash"))
    d = F.floor((F.col("p") - 1) / len(widths)).cast("int")
    start = F.greatest(d - F.col("at"), F.lit(0))
    parts, blocks = [], max(1, -(-sum(sizes.values()) // block))
    for b in range(blocks):
        side = found.drop("items")
        side = side.filter(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else side
        met = listed.join(F.broadcast(side), "hash", "left").filter(F.col("anchor").isNotNull() | (F.col("p") == 0) if b == 0 else F.col("anchor").isNotNull())  # broadcasts about BLOCK rows at most
        parts.append(met.select("doc_id", "_key", "anchor", "context", "at", "size", "width", F.size("words").cast("bigint").alias("n_words"), (d - F.col("at")).alias("shift"), start.alias("start"), F.slice("words", start + 1, F.size("context")).alias("near")))
    # Written first: as a join condition, the comparison would keep the join from being compiled.
    met = materialize(functools.reduce(DataFrame.unionByName, parts), "matches")
    exact = lambda i: F.translate(F.get("near", F.col("shift") + i - F.col("start")), UPPER, LOWER)
    differing = F.filter(F.sequence(F.lit(0), F.size("context") - 1), lambda i: ~F.coalesce(F.get("context", i) == exact(i), F.lit(False)))
    sure = met.filter("anchor is not null").withColumn("run", _run(differing)).filter("run is not null").join(found.select("anchor", "items"), "anchor")
    return sure.select("doc_id", "_key", "anchor", "items", (F.col("shift") + F.col("run.first")).alias("first"), (F.col("shift") + F.col("run.past")).alias("past")), met.filter("anchor is null").select("doc_id", "_key", "n_words")


def _run(differing: Column) -> Column:
    """first, past of the agreeing run around the shingle, within the context; null if it is shorter than a window or the shingle itself differs."""
    at, end = F.col("at"), F.col("at") + F.col("width")

    def settle(off: Column) -> Column:
        first = F.coalesce(F.array_max(F.filter(off, lambda i: i < at)) + 1, F.lit(0))
        past = F.coalesce(F.array_min(F.filter(off, lambda i: i >= end)), F.size("context"))
        good = ~F.exists(off, lambda i: (i >= at) & (i < end)) & (past - first >= F.col("size"))
        return F.when(good, F.struct(first.alias("first"), past.alias("past")))

    return F.get(F.transform(F.array(differing), settle), F.lit(0))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    covered, rows = spans(docs, benchmark, window, width, block)
    found = covered.groupBy("doc_id", "_key").agg(F.sort_array(F.collect_set(F.struct("first", "past"))).alias("spans"), F.collect_set("items").alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    hit = F.aggregate("spans", zero, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["past"] - F.greatest(acc["reach"], s["first"]))).alias("n"), F.greatest(acc["reach"], s["past"]).alias("reach")), lambda acc: acc["n"])
    found = found.select("doc_id", "_key", hit.cast("bigint").alias("n_hit"), F.array_distinct(F.flatten("items")).alias("items"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    found = found.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_text"), "n_hit", F.size("items").cast("bigint").alias("n_items"), listed.alias("listed"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_doc"]) & (rows["_key"] == found["_text"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, in which no benchmark window occurs."""
    covered, _ = spans(docs, benchmark)
    found = materialize(covered.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_text")).distinct(), "contaminated")
    text = F.col("text").cast("string")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(text, F.length(text)) == found["_text"]), "left_anti")
