"""Pages as a stream: detections as they arrive, and tables kept up to date batch by batch."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from uploadwatch import schemas
from uploadwatch.config import Settings
from uploadwatch.functions.urls import canonical_url
from uploadwatch.operators.ordinals import numbered
from uploadwatch.operators.registry import KEY
from uploadwatch.plans import run as batch_run
from uploadwatch.sources import tables
from uploadwatch.sources.buckets import BucketTable
from uploadwatch.sources.crawl import social_detections
from uploadwatch.sources.tables import Table


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages (query, html, seq, crawled_at) from Parquet files as they appear."""
    return spark.readStream.schema(schemas.PAGES + ", crawled_at timestamp").parquet(path)


def first_detections(pages: DataFrame, run_ts: str, late: str = "1 day") -> DataFrame:
    """A detection per canonical video address within the watermark, by the time pages were crawled; state is dropped once it passes."""
    found = social_detections(pages.withWatermark("crawled_at", late), run_ts, keep=("crawled_at",)).filter("failure is null").drop("failure").withColumn("_url", canonical_url(F.col("url")))
    return found.dropDuplicatesWithinWatermark(["_url"]).drop("_url")


def keep_tables(pages: DataFrame, detections: Table | BucketTable, registry: Table | BucketTable, catalog: list[str] | DataFrame, whitelist: DataFrame, run_ts: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Each micro-batch is a run whose merges are keyed by cluster.  Versions name the batch they hold, so a batch that is tried again changes nothing that it has written before.  Of tables in buckets only those a batch meets are rewritten."""
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def each(batch: DataFrame, number: int) -> None:
        if detections.holds(stream, number):
            return
        found = social_detections(batch, run_ts).filter("failure is null")
        done = batch_run.run(numbered(found, [F.col("place")]).drop("place", "failure"), whitelist, catalog, run_ts, registry.read((stream, number)), None if isinstance(detections, BucketTable) else detections.read(), settings)
        if not registry.holds(stream, number):
            if isinstance(registry, BucketTable):
                touched = batch_run.as_evidence_rows(done.evidence).select(*KEY).distinct()
                registry.merge(done.registry.join(touched, KEY, "left_semi"), tables.merge_offenders, (stream, number))
            else:
                registry.write(done.registry, (stream, number))
        if isinstance(detections, BucketTable):
            detections.merge(done.detections, tables.merge_detections, (stream, number))
        else:
            detections.write(done.detections, (stream, number))

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
