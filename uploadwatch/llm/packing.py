"""Packing (9): length buckets that waste the least padding, and batches within a token budget.

The global histogram of token counts is exact: an entry per distinct length.  Dynamic programming over it
finds the boundaries with the least total padding, near-linear in its entries, as best starts ascend; each document is padded to
its bucket's boundary, and each bucket is cut, in order of length, into batches of as many documents as the
budget holds.

Cases: null and empty texts have no tokens and pack into the first bucket as length 1; a document longer
than the budget has a batch of its own; repeated rows each take a place; rows with a null id sort first; rows of
one length and id are alike, so which of them comes first makes no difference; further columns are not read,
also those with names of results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.common import in_order
from uploadwatch.llm.tokens import TOKENIZER, token_counts
from uploadwatch.scratch import materialize

BUCKETS, BUDGET = 16, 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Ascending bucket boundaries over distinct ascending lengths that minimise the sum of count * (boundary - length)."""
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    size = np.array(lengths, np.float64)
    docs, mass = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(np.array(counts) * size)]

    def padding(first: np.ndarray, last: int) -> np.ndarray:
        """Of one bucket over entries first..last."""
        return size[last] * (docs[last + 1] - docs[first]) - (mass[last + 1] - mass[first])

    best = np.array([padding(np.array([0]), j)[0] for j in range(n)])
    chosen = [np.zeros(n, np.int64)]
    for _ in range(1, buckets):
        cost, start = np.empty(n), np.zeros(n, np.int64)
        cost[0] = best[0]
        left = [(1, n - 1, 0, n - 2)]  # entries, and the range of the places before their bucket's start
        while left:
            low, high, least, most = left.pop()
            if low > high:
                continue
            j = (low + high) // 2
            top = min(most, j - 1)
            options = best[least : top + 1] + padding(np.arange(least + 1, top + 2), j)
            k = least + int(np.argmin(options))
            cost[j], start[j] = (options[k - least], k + 1) if options[k - least] < best[j] else (best[j], chosen[-1][j])
            left += [(low, j - 1, least, k), (j + 1, high, k, most)]
        best = cost
        chosen.append(start)
    ends, j = [], n - 1
    for start in reversed(chosen):
        ends.append(lengths[j])
        if start[j] == 0:
            break
        j = int(start[j]) - 1
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, bucket (its boundary), batch (number within the bucket), place (within the batch), padding."""
    spark = docs.sparkSession
    lengths = materialize(token_counts(docs, tokenizer).withColumn("_entry", F.greatest("n_tokens", F.lit(1)).cast("bigint")), "lengths")
    histogram = sorted((r["_entry"], r["n"]) for r in lengths.groupBy("_entry").agg(F.count("*").alias("n")).collect())
    ends = boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    if not ends:
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint, bucket bigint, batch bigint, place bigint, padding bigint")
    bucket = F.element_at(F.filter(F.array(*map(F.lit, ends)), lambda e: e >= F.col("_entry")), 1).cast("bigint")
    placed = lengths.select("doc_id", "n_tokens", bucket.alias("bucket"), F.lit(1).cast("bigint").alias("one"))
    order = [F.col("bucket"), F.col("n_tokens"), F.col("doc_id").asc_nulls_first()]
    ranked = in_order(placed, order, "bucket", "one", "ranks")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("bigint")
    return ranked.select("doc_id", "n_tokens", "bucket", F.expr("before").alias("_at"), room.alias("_room")).select(
        "doc_id", "n_tokens", "bucket", F.floor(F.col("_at") / F.col("_room")).cast("bigint").alias("batch"), (F.col("_at") % F.col("_room")).alias("place"), (F.col("bucket") - F.col("n_tokens")).alias("padding")
    )
