"""Spelling variant grouping (12): words one edit apart, found by letter-parity bands.

Words are runs of Latin letters in small letters (A-Z only are turned), at least SHORTEST letters long and
OFTEN times in the corpus.  A word's mask holds for each letter whether it occurs an odd number of times; an
inserted or deleted letter flips one bit, a replaced one two.  Masks are split into three bands, so two words one edit apart agree
in at least one whole band.  Words are joined on an equal band, with lengths that differ by one at most, and
on one half: an edit leaves the head or the tail of the shorter length's half as it is.  That keeps the
buckets of a band, which are few however many words there are, from meeting in all pairs.  What is joined is
verified by edit distance; a pair counts at the first band and half that agree.

A word's form is its most frequent near word, if that is RATIO times as frequent; roots follow forms to
their end by pointer jumping (counts grow fivefold per step, so chains are short).

One misspelling is put in per PERIOD pairs of document and word, by their checksum, as the contract of the query
demands; ``period=None`` leaves words as they are.

Cases: null and empty texts have no words; a document whose id is null keeps its words as they are; rows that
share an id are read each for itself; no words give no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.common import bounded_batches, pieces, text_bytes
from uploadwatch.scratch import drop_table, materialize

SHORTEST, OFTEN, RATIO, PERIOD = 6, 5, 5, 199
RUN = re.compile("[A-Za-zÀ-ÿ]+")
HELD = 400_000  # words whose counts a task holds at once
#: Letters in the order of their frequency, dealt to the bands in turn, so that each band tells words apart.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xC0, 0x100)))
BIT = {letter: (k % 3, 1 << k // 3) for k, letter in enumerate(LETTERS)}
_SMALL = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def misspelt(word: str, seed: int, period: int) -> str:
    """word, or without one letter where the checksum of the document's id and the word says so."""
    checksum = zlib.crc32(word.encode(), seed)
    if checksum % period:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, period: int | None = PERIOD) -> DataFrame:
    """word, n: words of SHORTEST letters or more and their occurrences."""

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter = Counter()
                for piece in pieces(text.translate(_SMALL)):
                    own.update(RUN.findall(piece.decode("utf-8", "replace")))
                seed = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if len(word) >= SHORTEST:
                        if period and doc_id is not None:
                            word = misspelt(word, seed, period)
                            if len(word) < SHORTEST:
                                continue
                        counts[word] += n
                if len(counts) > HELD:
                    yield emit(counts)
                    counts.clear()
        if counts:
            yield emit(counts)

    found = bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def bands(word: str) -> list[int]:
    """The three bands of a word's mask of letters that occur an odd number of times."""
    out = [0, 0, 0]
    for letter in word:
        band, bit = BIT[letter]
        out[band] ^= bit
    return out


def _with_bands(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(bands, batch.column("word").to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.int32()) for f in found)], names=["word", "n", "b0", "b1", "b2"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, b0 int, b1 int, b2 int")


def _bucketed(words: DataFrame, roles: list[int]) -> DataFrame:
    """A row per band, half and role: 0 stands for a word beside another of its length, 1 beside a shorter one."""
    size = F.length("word")
    rows = words.select("*", F.explode(F.array(*(F.lit(r) for r in roles))).alias("role")).withColumn("size", size - F.col("role"))
    half = F.floor(F.col("size") / 2).cast("int")
    band = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("mask")) for i in range(3))))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("half")), F.struct(F.lit(1).alias("side"), F.substring(F.col("word"), size - half + 1, half).alias("half"))))
    return rows.select("*", band.alias("x")).select("*", "x.*", sides.alias("y")).select("word", "n", "b0", "b1", "b2", "role", "size", "band", "mask", F.col("y.side").alias("side"), F.xxhash64("y.half").alias("half"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words one inserted, deleted or replaced letter apart, once."""
    keyed = materialize(_with_bands(words), "bands")
    left = _bucketed(keyed, [0]).select(*(F.col(c).alias(f"l_{c}") for c in ("word", "n", "b0", "b1", "b2")), "size", "band", "mask", "side", "half")
    right = _bucketed(keyed, [0, 1])
    met = left.join(right, ["size", "band", "mask", "side", "half"])
    same = lambda i: F.col(f"l_b{i}") == F.col(f"b{i}")
    first_band = F.when(same(0), 0).when(same(1), 1).otherwise(2)
    flipped: Column = sum((F.bit_count(F.col(f"l_b{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(3)), F.lit(0))
    half = F.floor(F.col("size") / 2).cast("int")
    heads_agree = F.substring("l_word", F.lit(1), half) == F.substring("word", F.lit(1), half)
    once = (F.col("band") == first_band) & ((F.col("side") == 0) | ~heads_agree) & ((F.col("role") == 1) | (F.col("l_word") < F.col("word")))
    near = met.filter(once & (flipped <= 2)).filter(F.levenshtein("l_word", "word", 1) == 1)
    return near.select(F.col("l_word").alias("a"), F.col("l_n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root for every word that has a form (links: word, form): forms followed to the last."""
    now = materialize(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        drop_table(now)
        now = further
    return now.select("word", "root")


def variants(docs: DataFrame, period: int | None = PERIOD) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of SHORTEST letters that occurs OFTEN times."""
    words = materialize(word_counts(docs, period).filter(F.col("n") >= OFTEN), "words")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), best)
    taken = F.col("near_n") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))
    found = materialize(found.select("word", F.when(taken, F.col("near")).alias("form"), "n", "n_near", F.when(taken, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
