"""Components and clusters that grow, against those of everything at once."""

import random

from uploadwatch import schemas
from uploadwatch.operators import cluster, components, growing


def pairs(df):
    return {(r[0], r[1]) for r in df.collect()}


def test_components_of_batches(spark, tmp_path):
    rng = random.Random(6)
    some = lambda: [(rng.randrange(120), rng.randrange(120)) for _ in range(25)]
    batches = [some() + [(1000 + i, 1001 + i) for i in range(12)], [(None, 3), (4, None), (7, 7)], some() + [(1006, -5), (-5, 60)]]
    kept, seen = growing.GrowingComponents(spark, str(tmp_path / "g"), 8), []
    for n, edges in enumerate(batches):
        before, seen = pairs(kept.read()), seen + edges
        changed = pairs(kept.add(spark.createDataFrame(edges, "a bigint, b bigint"), ("s", n)))
        wanted = pairs(components.components(spark.createDataFrame(seen, "a bigint, b bigint"))) if seen else set()
        assert pairs(kept.read()) == wanted and changed == wanted - before
        assert {(b, a) for a, b in pairs(kept.members.read())} == wanted


def test_a_batch_tried_again(spark, tmp_path):
    make = lambda edges: spark.createDataFrame(edges, "a bigint, b bigint")
    kept = growing.GrowingComponents(spark, str(tmp_path / "g"), 8)
    kept.add(make([(1, 2), (5, 6)]), ("s", 0))
    merge, kept.nodes.merge = kept.nodes.merge, lambda *a: 1 / 0  # the second table is not reached
    try:
        kept.add(make([(2, 6), (0, 9)]), ("s", 1))
    except ZeroDivisionError:
        pass
    kept.nodes.merge = merge
    assert pairs(kept.read()) == {(1, 1), (2, 1), (5, 5), (6, 5)} and kept.members.holds("s", 1)
    for _ in range(2):
        kept.add(make([(2, 6), (0, 9)]), ("s", 1))
        assert pairs(kept.read()) == {(1, 1), (2, 1), (5, 1), (6, 1), (0, 0), (9, 0)} == {(b, a) for a, b in pairs(kept.members.read())}


def test_a_batch_leaves_other_buckets(spark, tmp_path):
    kept = growing.GrowingComponents(spark, str(tmp_path / "g"), 32)
    kept.add(spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(2000)], "a bigint, b bigint"))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "g").rglob("*.parquet")}
    before = files()
    assert pairs(kept.add(spark.createDataFrame([(10, 21)], "a bigint, b bigint"))) == {(20, 10), (21, 10)}
    new = files().keys() - before.keys()
    assert len({p.parent.name for p in new if "/nodes/" in str(p)}) <= 2 and len({p.parent.name for p in new if "/members/" in str(p)}) <= 2
    assert {p: t for p, t in files().items() if p in before} == before


def test_clusters_of_runs(spark, tmp_path):
    rng = random.Random(9)
    rows = [("facebook", rng.choice(["https://m.facebook.com/watch?v={}", "https://www.facebook.com/watch?v={}&utm_source=a", None]), rng.choice(["Liga", "liga HD", "Film", "", None]), f"c{rng.randrange(12)}") for _ in range(90)]
    full = [(p, u and u.format(rng.randrange(40)), t, c, "", "", "2026-01-01T00:00:00Z", "", None, n) for n, (p, u, t, c) in enumerate(rows)]
    rng.shuffle(full)  # later runs hold smaller numbers too
    kept = growing.GrowingClusters(spark, str(tmp_path / "c"), 8)
    for n in range(2):
        kept.add(spark.createDataFrame(full[n * 45 : n * 45 + 45], schemas.DETECTION), ("s", n))
    every = spark.createDataFrame(full, schemas.DETECTION)
    found = components.components(cluster.title_edges(every).unionByName(cluster.url_edges(every.filter("url is not null"))))
    assert pairs(kept.read()) == pairs(found)
