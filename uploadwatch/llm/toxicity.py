"""Toxicity (6): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of single words, word pairs and pairs with one word between, hashed to 2^20
coordinates.  FTRL-proximal keeps a learning rate per coordinate and drives coordinates without evidence to
exactly zero (L1), so the weights that score the whole corpus are few and small to broadcast.

The model is fitted on a bounded sample of labelled rows: at most TRAIN_TOXIC toxic and TRAIN_CLEAN clean
ones, those whose id hashes lowest.  One executor task fits it, and the driver gets the non-zero weights only.
L1 shrinks sums, and the sample holds toxic rows more often than the labels do, so sums are calibrated: FOLDS further
models, each fitted without one part of the sample, score that part; a scale and a shift make probabilities of these sums,
and the shift takes the share of toxic rows from all labels.  Both go into the weights and the bias.
Rows with crc32(doc_id) mod 3 = 1 are held out and never learned from.  Scores depend on the text alone.

Cases: null and empty texts have no features and get the score of the bias; a null doc_id is scored, not
learned from, and not held out; rows that share a doc_id are scored each for itself, and the one whose text
hashes lowest is learned from; where labels repeat the highest counts; without labels of both kinds every score is 0; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.common import bounded_batches, row_key, text_bytes

BITS = 20
TRAIN_TOXIC, TRAIN_CLEAN = 6_000, 9_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.0, 6  # L1 by the loss on parts of the sample that were left out
FOLDS = 3
THRESHOLD = 0.7
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)
#: Letters and digits make words; what else ASCII has stands between them.
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Distinct coordinates of a text."""
    import xxhash

    words = np.array(list(map(xxhash.xxh64_intdigest, text.translate(_WORDS).split())), np.uint64)
    parts = [words * _PAIR, (words[:-1] * _PAIR + words[1:]) * _SKIP, (words[:-2] * _SKIP + words[2:]) * _PAIR]
    return np.unique(np.concatenate(parts) >> _SHIFT).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero coordinates, their weights and the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        found = -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) <= L1, 0.0, found)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at = np.append(rows[k], size)
            w = weights(at)
            gap = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            step = gap * gap
            z[at] += gap - (np.sqrt(n[at] + step) - np.sqrt(n[at])) / ALPHA * w
            n[at] += step
    every = weights(np.arange(size + 1))
    at = np.flatnonzero(every[:size])
    return at.astype(np.int32), every[at], float(every[size])


def calibrate(sums: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make log odds of sums of rows that were not learned from.

    Logistic regression on the sums by Newton's method, towards a scale of 1 by a normal prior and with labels drawn in by
    one made-up row of each kind, so that it ends where sums part the labels cleanly.
    """
    high = labels.sum()
    target = np.where(labels > 0, (high + 1) / (high + 2), 1 / (len(labels) - high + 2))
    x = np.stack([sums, np.ones(len(sums))])
    prior = np.diag([1.0, 1e-3])

    def loss(at: np.ndarray) -> float:
        z = at @ x
        return float((np.logaddexp(0, z) - target * z).sum() + (at - [1, 0]) @ prior @ (at - [1, 0]) / 2)

    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = _probability(at @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + prior, x @ (p - target) + prior @ (at - [1, 0]))
        pace = 1.0
        while pace > 1e-6 and loss(at - pace * step) > loss(at):
            pace /= 2
        at = at - pace * step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def left_out_sums(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Each row's sum by a model of the other parts; a part's rows stay nan where the others have labels of one kind."""
    part, out, dense = np.arange(len(rows)) % folds, np.full(len(rows), np.nan), np.zeros(1 << BITS)
    for k in range(folds):
        others = labels[part != k]
        if not 0 < others.sum() < len(others):
            continue
        at, values, bias = fit([x for x, p in zip(rows, part) if p != k], others)
        dense[:] = 0
        dense[at] = values
        out[part == k] = [dense[rows[i]].sum() + bias for i in np.flatnonzero(part == k)]
    return out


def fit_calibrated(rows: list[np.ndarray], labels: np.ndarray, odds: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """As ``fit``, in log odds; ``odds`` of a toxic row among all labels, if other than the sample's."""
    at, values, bias = fit(rows, labels)
    sums = left_out_sums(rows, labels)
    seen = ~np.isnan(sums)
    scale, shift = calibrate(sums[seen], labels[seen]) if seen.any() else (1.0, 0.0)
    if odds is not None:
        shift += float(np.log(odds) - np.log(labels.sum() / (len(labels) - labels.sum())))
    return at, values * scale, bias * scale + shift


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = [known.filter(rule).orderBy(order, "doc_id").limit(most) for rule, most in (("toxic = 1", TRAIN_TOXIC), ("toxic <> 1", TRAIN_CLEAN))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", (F.col("toxic") == 1).cast("int").alias("label")))  # at most TRAIN_TOXIC + TRAIN_CLEAN rows

    n_toxic, n_clean = known.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    odds = n_toxic / n_clean if n_toxic and n_clean else None

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, marks = [], []
        for batch in batches:
            kept += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("features")]
            marks += batch.column("label").to_pylist()
        if 0 < sum(marks) < len(marks):
            at, values, bias = fit_calibrated(kept, np.array(marks, np.float64), odds)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(values, bias))], names=["at", "weight"])

    # Of several texts of one id always the same is learned from.
    rows = bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"), row_key().alias("_key")).join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", "_key").alias("text"))
    # The sample is bounded, so one executor task holds it; only the weights that L1 leaves reach the driver.
    got = rows.mapInArrow(prepare, "doc_id bigint, label int, features binary").repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "at int, weight double").collect()
    held = sorted((r["at"], r["weight"]) for r in got)
    if not held:
        return np.empty(0, np.int32), np.empty(0), -np.inf
    at, values = zip(*held)
    return np.array(at[1:], np.int32), np.array(values[1:]), values[0]


def _probability(sums: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-sums))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    at, values, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, values.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            sums = np.array([dense[features(t)].sum(dtype=np.float64) for t in batch.column("text").to_pylist()]) + bias
            scores = _probability(sums)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id").cast("bigint")).alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that the model does not score as toxic."""
    at, values, bias = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((at, values.astype(np.float32)))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            sums = np.array([dense[features(t or b"")].sum(dtype=np.float64) for t in batch.column(place).cast(pa.binary()).to_pylist()]) + bias
            yield batch.filter(pa.array(_probability(sums) < threshold))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
