"""Title lists, whitelists and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uploadwatch import schemas
from uploadwatch.functions.text import stripped
from uploadwatch.scratch import exists


def titles(spark: SparkSession, path: str) -> DataFrame:
    """seq, title: stripped lines; blank ones and those that start with # at column 0 are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("seq", "line"))
    return lines.filter((stripped(F.col("line")) != "") & ~F.col("line").startswith("#")).select(F.col("seq").cast("bigint").alias("seq"), stripped(F.col("line")).alias("title"))


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """channel_id: stripped lines; blank ones and comments, also indented ones, are left out.  No file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "channel_id string")
    lines = spark.read.text(path).select(stripped(F.col("value")).alias("channel_id"))
    return lines.filter((F.col("channel_id") != "") & ~F.col("channel_id").startswith("#")).distinct()


def run_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row; unknown keys are ignored, absent ones are 0 or empty."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    given = spark.read.schema(schemas.STATS).json(path, multiLine=True)
    return given.select(*(F.coalesce(c, F.lit(0).cast(t) if not t.startswith("array") else F.array().cast(t)).alias(c) for c, t in given.dtypes))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)
