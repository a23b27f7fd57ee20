"""Tables in buckets against merges of whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from uploadwatch import schemas
from uploadwatch.sources import buckets, tables


def rows(spark, keys, score):
    values = {"cluster_id": F.col("k"), "score": F.lit(score), "status": F.lit("new"), "first_detected": F.lit(str(score)), "last_detected": F.lit(str(score))}
    kinds = dict(part.split() for part in schemas.DETECTIONS_TABLE.split(", "))
    return spark.createDataFrame([(k,) for k in keys], "k string").select(*(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def found(df):
    return sorted((r.cluster_id, r.score, r.first_detected, r.last_detected) for r in df.collect())


def test_merges_touch_what_they_meet(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), schemas.DETECTIONS_TABLE, ["cluster_id"], 32)
    assert table.read().count() == 0
    rng, whole = random.Random(1), spark.createDataFrame([], schemas.DETECTIONS_TABLE)
    for n, keys in enumerate(([f"k{i}" for i in range(400)], rng.sample([f"k{i}" for i in range(500)], 10), [], ["k7", None])):
        batch = rows(spark, keys, n)
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
        written = table.merge(batch, tables.merge_detections, ("s", n))
        assert len(written) <= len(keys) and {p: p.stat().st_mtime_ns for p in before if p.exists()}.items() <= before.items()
        new = {p.parent.name for p in (tmp_path / "t").rglob("*.parquet") if p not in before}
        assert new == {f"_bucket={k}" for k in written}
        whole = spark.createDataFrame(tables.merge_detections(whole, batch).collect(), schemas.DETECTIONS_TABLE)
        key = lambda x: tuple(map(str, x))
        assert sorted(((r.cluster_id, r.score, r.first_detected) for r in table.read().collect()), key=key) == sorted(((r.cluster_id, r.score, r.first_detected) for r in whole.collect()), key=key)
    assert table.holds("s", 3) and not table.holds("s", 4) and not table.holds("x", 0)
    assert table.read(("s", 3)).filter("cluster_id is null").count() == 0 and table.read().filter("cluster_id is null").count() == 1


def test_a_second_writer_fails(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), schemas.DETECTIONS_TABLE, ["cluster_id"], 8)
    table.merge(rows(spark, ["a", "b"], 1), tables.merge_detections)

    def slow(old, new):
        table.merge(rows(spark, ["c"], 2), tables.merge_detections)  # another writer, while this one works
        return tables.merge_detections(old, new)

    with pytest.raises(buckets.ConcurrentWrite):
        table.merge(rows(spark, ["a"], 3), slow)
    assert found(table.read()) == [("a", 1, "1", "1"), ("b", 1, "1", "1"), ("c", 2, "2", "2")]


def test_a_stream_keeps_buckets(spark, tmp_path):
    from uploadwatch.streaming import watch

    held = [buckets.BucketTable(spark, str(tmp_path / n), s, k, 8) for n, s, k in (("d", schemas.DETECTIONS_TABLE, ["cluster_id"]), ("r", schemas.OFFENDER, ["platform", "permanent_id"]))]
    page = '<a href="/reel/123456{0}/" title="Liga Champions">x</a>'
    for n in range(2):
        spark.createDataFrame([("q", page.format(n), n)], "query string, html string, seq bigint").selectExpr("*", "timestamp '2026-01-01' as crawled_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        q = watch.keep_tables(watch.page_stream(spark, str(tmp_path / "pages")), *held, ["Liga Champions"], spark.createDataFrame([], "channel_id string"), "now", str(tmp_path / "check"))
        q.awaitTermination()
    assert sorted(r.content_url.rstrip("/")[-7:] for r in held[0].read().collect()) == ["1234560", "1234561"]
