"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset, a temporary folder on a local master and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="uploadwatch-")
    return _OWN_ROOT[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/uploadwatch/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing will read again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


@atexit.register
def _drop_all() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
