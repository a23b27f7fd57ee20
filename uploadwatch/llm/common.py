"""Shared pieces of the training-data operators: keys, batches and ordered numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch.scratch import materialize

BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20  # rows carry whole texts, so Spark's own 10,000 rows could fill a worker


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def row_key(column: str = "text") -> Column:
    """Tells apart rows that share an id but not a text; equal rows have equal keys."""
    return F.xxhash64(F.col(column), F.length(column))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, once its session sends Python workers batches of BATCH_ROWS rows and BATCH_BYTES at most; smaller settings stay."""
    conf = df.sparkSession.conf
    for key, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        try:
            held = int(conf.get(key, str(usual)))
        except ValueError:  # a size with its unit, set by the user
            continue
        if not 0 < held <= most:
            conf.set(key, most)
    return df


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data, whose words stand between single-byte blanks, in parts of about ``size`` bytes that cut no word."""
    start = 0
    while len(data) - start > size:
        cut = data.find(b" ", start + size)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:] if start else data


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One Arrow record batch in, one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return bounded_batches(df).mapInArrow(run, schema)


def in_order(df: DataFrame, order: list[Column], group: str | None, amount: str, label: str) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over all rows that precede a row in ``order``.

    With ``group`` (which must lead the order) sums restart at each group.  Rows are dealt by range and
    summed within partitions; what goes through the driver is one total per partition and group value.
    """
    columns = df.columns
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", _within bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, last = 0, None
        for batch in batches:
            values = batch.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.empty(len(values), np.int64)
            if group is None:
                sums = np.cumsum(values)
                out[:] = total + sums - values
                total += int(sums[-1]) if len(sums) else 0
            else:
                keys = batch.column(group).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
                for a, b in zip(starts, [*starts[1:], len(keys)]):
                    if keys[a] != last:
                        total, last = 0, keys[a]
                    sums = np.cumsum(values[a:b])
                    out[a:b] = total + sums - values[a:b]
                    total += int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_within"])

    local = materialize(ranged.mapInArrow(run, schema), label)
    keys = ["_part"] + ([group] if group else [])
    totals = sorted(local.groupBy(*keys).agg(F.max(F.col("_within") + F.col(amount)).alias("n")).collect())
    sums: dict = {}
    rows = []
    for r in totals:
        g = r[group] if group else None
        rows.append((r["_part"], *([g] if group else []), sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + r["n"]
    kinds = "_part int" + (f", `{group}` {dict(local.dtypes)[group]}" if group else "") + ", _base bigint"
    base = F.broadcast(df.sparkSession.createDataFrame(rows, kinds))  # a row per partition (and group value)
    return local.join(base, keys).select(*columns, (F.col("_base") + F.col("_within")).alias("before"))
