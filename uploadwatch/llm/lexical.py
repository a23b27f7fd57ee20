"""Ranked lexical search (11): block-max pruning over a forward index of document ranges.

One pass over the texts writes a forward index: consecutive documents make a block, which holds each
document's terms, and for every term that occurs in it how many documents have it, the largest number of
occurrences and the shortest such document.  From these the block's maximum for a term follows once the
corpus statistics are known.  For a query, blocks are sorted by the sum of their maxima, and documents are
scored block by block until that bound drops below the kth score so far.  Ties go to the smaller doc_id, so
a block at the very threshold is still scored.

Queries are a stated set against all rows, in groups of at most TERMS distinct (item, term) pairs; the index
holds the terms of a group's items only, the statistics cover all documents.  Every LEAD-th block is
searched first, and its kth scores are where the search of the rest starts: a lower bound that changes no
result.  What reaches the driver is one group's items and, per term or item of it, a number.

Cases: null and empty texts, and texts without a term, count nowhere and are never listed; a document
whose id is null counts in the statistics and is listed after all others of its score; rows that share an id
are ranked each for itself; texts of one item_id (a null one too) are one item, equal texts once; items
without terms list nothing; further columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uploadwatch.llm.common import bounded_batches, pieces, text_bytes
from uploadwatch.llm.decontam import LOWER, UPPER, WORD, words_of
from uploadwatch.scratch import materialize

K, TERM = 20, WORD
BLOCK_DOCS, BLOCK_POSTINGS = 64, 1 << 16  # a block ends with the document that reaches either
TERMS = 200_000  # (item, term) pairs of one group of queries
GROUP_CELLS, GROUP_POSTINGS = 1 << 23, 1 << 22  # what a task holds of the index at once
LEAD = 16
#: Control characters, blanks and ASCII punctuation stand between terms; A-Z become small letters.
_TERMS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_INDEX = "lead boolean, docs bigint, total bigint, doc_id array<bigint>, length array<bigint>, n_terms array<int>, term array<int>, tf array<int>, held array<int>, df array<int>, top_tf array<int>, shortest array<bigint>"
_LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times for every term of every item."""
    texts = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    return texts.select("item_id", F.explode(words_of(F.translate("text", UPPER, LOWER))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row per block: documents and terms it saw, its forward lists (one run of ``term`` and ``tf`` per document), and per term held what bounds it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # TERMS entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size, made = shared.value, len(shared.value), 0
        block: list[tuple] = []  # id, length, terms, tf of documents that hold a term
        docs_seen = total = postings = 0

        def close() -> pa.RecordBatch:
            nonlocal made
            term = np.concatenate([b[2] for b in block]) if block else np.empty(0, np.int32)
            tf = np.concatenate([b[3] for b in block]) if block else np.empty(0, np.int32)
            counts = np.array([len(b[2]) for b in block], np.int32)
            length = np.array([b[1] for b in block], np.int64)
            order = np.argsort(term, kind="stable")
            held, first, df = np.unique(term[order], return_index=True, return_counts=True)
            top = np.maximum.reduceat(tf[order], first) if len(held) else tf
            low = np.minimum.reduceat(np.repeat(length, counts)[order], first) if len(held) else length
            made += 1
            values = [made % LEAD == 1, docs_seen, total, [b[0] for b in block], length, counts, term, tf, held, df.astype(np.int32), top, low]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ARROW)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                length, found = 0, []
                for piece in pieces(text.translate(_TERMS)):
                    words = piece.split()
                    length += len(words)
                    at = np.fromiter((known.get(w, size) for w in words), np.int32, len(words))
                    found.append(np.bincount(at[at < size], minlength=0).astype(np.int64))
                if not length:
                    continue
                docs_seen, total = docs_seen + 1, total + length
                sums = np.zeros(max(map(len, found)), np.int64)
                for f in found:
                    sums[: len(f)] += f
                terms = np.flatnonzero(sums).astype(np.int32)
                if len(terms):
                    block.append((doc_id, length, terms, sums[terms].astype(np.int32)))
                    postings += len(terms)
                if docs_seen >= block_docs or postings >= BLOCK_POSTINGS:
                    yield close()
                    block, docs_seen, total, postings = [], 0, 0, 0
        if docs_seen:
            yield close()

    return bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, _INDEX)


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_NAMES = [part.split()[0] for part in _INDEX.split(", ")]
_ARROW = [pa.bool_(), pa.int64(), pa.int64(), _LONGS, _LONGS, _INTS, _INTS, _INTS, _INTS, _INTS, _INTS, _LONGS]


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N and L of all documents, and how many documents have each term of the index."""
    n, total = index.agg(F.sum("docs"), F.sum("total")).first()
    df = index.select(F.explode(F.arrays_zip("held", "df")).alias("x")).groupBy("x.held").agg(F.sum("x.df").alias("df")).collect()  # a row per term of the group
    return n or 0, total or 0, {r["held"]: r["df"] for r in df}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def share(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied by; it grows with tf and falls with a document's length."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * length * n) // total))


class _Best:
    """A query's best documents so far."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.doc = np.empty(0, np.int64), np.empty((0, 2), np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        """doc: id and whether it is null."""
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc[:, 1], doc[:, 0], -score))[: self.k]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


class _Group:
    """Some blocks of the index, with their maxima as a table of blocks by terms."""

    def __init__(self, rows: list[dict], size: int, n: int, total: int):
        self.rows, self.n, self.total = rows, n, total
        self.most = np.zeros((len(rows), size), np.int64)
        for b, r in enumerate(rows):
            self.most[b, r["held"]] = share(r["top_tf"].astype(np.int64), r["shortest"], n, total)
        self.lists: dict[int, tuple] = {}

    def lists_of(self, b: int) -> tuple:
        """Terms, shares, where documents begin, and the documents; worked out for blocks that a query meets."""
        if b not in self.lists:
            r = self.rows[b]
            part = share(r["tf"].astype(np.int64), np.repeat(r["length"], r["n_terms"]), self.n, self.total)
            self.lists[b] = (r["term"], part, np.cumsum(r["n_terms"]) - r["n_terms"], r["doc"])
        return self.lists[b]

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: _Best) -> int:
        """Score blocks in the order of their bounds while these reach the kth score; the number of blocks scored."""
        bounds = self.most[:, terms] @ weights
        dense[terms] = weights
        met = 0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] < max(best.floor, 1):
                break
            term, part, starts, doc = self.lists_of(b)
            score = np.add.reduceat(dense[term] * part, starts)
            kept = score >= max(best.floor, 1)
            met += 1
            if kept.any():
                best.add(score[kept], doc[kept])
        dense[terms] = 0
        return met


def search(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, n: int, total: int, floors: list[int], k: int = K) -> DataFrame:
    """q, doc_id, score: what each task's part of the index has of a query's k best that reach its floor.

    ``queries`` holds the terms of each query and their weights times their repeats.
    """
    shared = index.sparkSession.sparkContext.broadcast((queries, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = shared.value
        best = [_Best(k, f) for f in least]
        dense = np.zeros(size, np.int64)
        rows: list[dict] = []
        postings = 0

        def settle() -> None:
            group = _Group(rows, size, n, total)
            for (terms, weights), own in zip(asked, best):
                group.search(terms, weights, dense, own)

        for batch in batches:
            lists = {name: batch.column(name) for name in ("doc_id", "length", "n_terms", "term", "tf", "held", "top_tf", "shortest")}
            for i in range(batch.num_rows):
                if not len(ids := lists["doc_id"][i].values):
                    continue
                row = {name: column[i].values.to_numpy(zero_copy_only=False) for name, column in lists.items() if name != "doc_id"}
                null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
                row["doc"] = np.stack([ids.fill_null(_LAST).to_numpy(zero_copy_only=False), null], 1)
                rows.append(row)
                postings += len(row["term"])
                if postings >= GROUP_POSTINGS or len(rows) * size >= GROUP_CELLS:
                    settle()
                    rows, postings = [], 0
        if rows:
            settle()
        for q, own in enumerate(best):
            if len(own.score):
                ids = pa.array(own.doc[:, 0], pa.int64(), mask=own.doc[:, 1].astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.score), q), pa.int32()), ids, pa.array(own.score)], names=["q", "doc_id", "score"])

    columns = ["doc_id", "length", "n_terms", "term", "tf", "held", "top_tf", "shortest"]
    return bounded_batches(index).select(*columns).mapInArrow(run, "q int, doc_id bigint, score bigint")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_docs: int = BLOCK_DOCS, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    asked = materialize(item_terms(items), "item-terms")
    groups = max(1, -(-asked.count() // terms))
    found = []
    kind = asked.schema["item_id"].dataType.simpleString()
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else asked
        rows = own.collect()  # about TERMS rows at most
        vocabulary = {t: k for k, t in enumerate(sorted({r["term"] for r in rows}))}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r["item_id"], {})[vocabulary[r["term"]]] = r["times"]
        named = list(by_item)
        index = materialize(forward_index(docs, {t.encode(): k for t, k in vocabulary.items()}, block_docs), "forward-index")
        n, total, df = statistics(index)
        weights = np.array([weight(n, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        queries = []
        for item in named:
            own_terms = np.array(sorted(by_item[item]), np.int64)
            queries.append((own_terms, weights[own_terms] * np.array([by_item[item][t] for t in own_terms.tolist()], np.int64)))
        part = functools.partial(search, queries=queries, size=len(vocabulary), n=n, total=total, k=k)
        lead = materialize(part(index.filter("lead"), floors=[0] * len(queries)), "lead-hits")
        reached = {r["q"]: r["floor"] for r in _ranked(lead, k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k).collect()}  # a row per item of the group
        rest = part(index.filter("not lead"), floors=[reached.get(q, 0) for q in range(len(queries))])
        names = F.broadcast(spark.createDataFrame(list(enumerate(named)), f"q int, item_id {kind}"))  # a row per item of the group
        found.append(_ranked(lead.unionByName(rest), k).join(names, "q").select("item_id", "rank", "doc_id", "score"))
    return functools.reduce(DataFrame.unionByName, found)
