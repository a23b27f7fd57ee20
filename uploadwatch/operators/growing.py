"""Components and clusters that are kept from run to run and take in what is new.

A batch is joined with the buckets that its own nodes and keys meet; its edges are contracted to labels, and only members of
components that grow together get another label.  So what a batch reads and writes follows the batch and the components it
joins, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uploadwatch.functions.text import canonical
from uploadwatch.functions.urls import canonical_url
from uploadwatch.operators.components import components
from uploadwatch.scratch import materialize
from uploadwatch.sources.buckets import BUCKETS, BucketTable


def _latest(key: str):
    """Rows of a batch in place of those that have the same key."""
    return lambda old, new: old.join(new, key, "left_anti").unionByName(new)


class GrowingComponents:
    """Components (node, component: its least node) of all edges added so far, in two tables: by node and by component.

    Edges with a null end or two equal ends are none.  A batch that is named (stream, number) and tried again changes
    nothing that it has written before: both tables name the batches they hold, and what is missing is worked out from
    the state before.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, kind: str = "bigint"):
        self.nodes = BucketTable(spark, f"{path}/nodes", f"node {kind}, component {kind}", ["node"], buckets)
        self.members = BucketTable(spark, f"{path}/members", f"component {kind}, node {kind}", ["component"], buckets)

    def read(self) -> DataFrame:
        return self.nodes.read()

    def add(self, edges: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Takes in edges (a, b); gives node, component of the nodes whose component is new or another."""
        edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "new-edges")
        ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        known = materialize(ends.join(self.nodes.meeting(ends, batch), "node", "left").select("node", "component"), "ends")
        label = lambda end: known.select(F.col("node").alias(end), F.coalesce("component", "node").alias(f"l{end}"))
        contracted = edges.join(label("a"), "a").join(label("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        joined = materialize(components(contracted).withColumnRenamed("node", "old"), "joined-labels")
        moved = joined.filter("old <> component")
        # Members of labels that fell to another, and new nodes under whatever their label became.
        held = self.members.meeting(moved.select(F.col("old").alias("component")), batch).withColumnRenamed("component", "old")
        fresh = known.filter("component is null").select("node").join(joined.withColumnRenamed("old", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        changed = materialize(held.join(moved, "old").select("node", "component").unionByName(fresh), "new-labels")
        gone = moved.join(held.select("old").distinct(), "old", "left_semi").select(F.col("old").alias("component"), F.lit(None).cast(self.nodes.read().schema["node"].dataType).alias("node"))
        places = changed.select("component", "node").unionByName(gone)
        if batch is None or not self.members.holds(*batch):
            self.members.merge(places, _moved, batch)
        if batch is None or not self.nodes.holds(*batch):
            self.nodes.merge(changed, _latest("node"), batch)
        return changed


def _moved(old: DataFrame, places: DataFrame) -> DataFrame:
    """Members after a batch: a row without node empties its component."""
    gone = places.filter("node is null").select("component")
    return old.join(gone, "component", "left_anti").unionByName(places.filter("node is not null"))


class GrowingClusters:
    """Components of detections by canonical address, and by channel and canonical title, run after run.

    ``firsts`` holds the least seq of each key, so a batch meets older detections without reading them; seq is unique over
    all runs.  Detections that are alone stand in no component and are their own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.firsts = BucketTable(spark, f"{path}/firsts", "key string, seq bigint", ["key"], buckets)
        self.parts = GrowingComponents(spark, f"{path}/parts", buckets)

    def add(self, detections: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Takes in detections; gives seq, component of those, of whatever run, whose component is new or another."""
        titled = F.concat_ws("\0", F.lit("title"), F.coalesce("platform", F.lit("")), F.coalesce("channel_id", F.lit("")), canonical(F.coalesce("title", F.lit(""))))
        addressed = F.concat_ws("\0", F.lit("url"), canonical_url(F.col("url")))
        known = F.when(F.col("url").isNotNull(), F.array(addressed, titled)).otherwise(F.array(titled))
        keyed = materialize(detections.select(F.col("seq").cast("bigint").alias("seq"), F.explode(known).alias("key")), "keys")
        least = keyed.groupBy("key").agg(F.min("seq").alias("least"))
        before = self.firsts.meeting(least, batch).withColumnRenamed("seq", "before")
        firsts = materialize(least.join(before, "key", "left").select("key", "before", F.least("least", "before").alias("first")), "firsts")
        to_old = firsts.select(F.col("before").alias("a"), F.col("first").alias("b"))
        changed = self.parts.add(keyed.join(firsts, "key").select(F.col("seq").alias("a"), F.col("first").alias("b")).unionByName(to_old), batch)
        if batch is None or not self.firsts.holds(*batch):
            self.firsts.merge(firsts.filter("before is null or first < before").select("key", F.col("first").alias("seq")), _latest("key"), batch)
        return changed.withColumnRenamed("node", "seq")

    def read(self) -> DataFrame:
        """seq, component of the detections that are not alone."""
        return self.parts.read().withColumnRenamed("node", "seq")
