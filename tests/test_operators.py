"""Clusters, scores, registry, tables and health."""

import random

import pytest
from pyspark.sql import functions as F

from uploadwatch import config, schemas
from uploadwatch.operators import cluster, components, health, registry, score, search
from uploadwatch.plans import run
from uploadwatch.sources import files, tables


def detections(spark, rows):
    """rows of (seq, url, title, channel, snapshot, detected_at), the last four optional."""
    full = [("facebook", u, t, c, "", s, d, "", None, n) for n, u, t, c, s, d in (tuple(r) + ("", "ch", "", "2026-01-01T00:00:00Z")[len(r) - 2 :] for r in rows)]
    return spark.createDataFrame(full, schemas.DETECTION)


def groups(members):
    out = {}
    for r in members.collect():
        out.setdefault(r.component, set()).add(r.seq)
    return sorted(map(sorted, out.values()))


def test_components_by_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_passes(spark):
    d = detections(spark, [
        (0, "https://m.facebook.com/watch?v=1&utm_source=a"), (1, "https://www.facebook.com/watch?v=1", "One", "c7"), (2, "https://x/2", "Liga Champions 2025", "c1"), (3, "https://x/3", "liga champions 2025 HD", "c1"), (4, "https://x/4", "Liga Champions 2025", "c2"),
        (5, "https://x/5", "2025 Champions Liga extra", "c1"), (6, "https://x/6", "", "c9"), (7, "https://x/7", None, "c9"),
    ])
    assert groups(cluster.deduplicate(d, fuzzy_threshold=None)) == [[0, 1], [2, 3], [4], [5], [6, 7]]
    assert groups(cluster.deduplicate(d)) == [[0, 1], [2, 3, 5], [4], [6, 7]]
    assert groups(cluster.deduplicate(d, fuzzy_threshold=None, by_url=False)) == [[0], [1], [2, 3], [4], [5], [6, 7]]


def test_fuzzy_pairs_by_brute_force(spark):
    from uploadwatch.functions.text import token_set_similarity

    rng = random.Random(4)
    words = ["liga", "champions", "sinetron", "cinta", "episode", "episodes", "final", "a", "b2"]
    rows = [(i, f"https://x/{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), f"c{i % 3}") for i in range(60)]
    first = {}
    for i, _, t, c in rows:
        first.setdefault((c, t), i)
    wanted = {(max(i, j), min(i, j)) for (c, t), i in first.items() for (k, u), j in first.items() if i < j and c == k and token_set_similarity(t, u) >= config.FUZZY_THRESHOLD}
    assert {(r.a, r.b) for r in cluster.fuzzy_edges(detections(spark, rows), block=3).collect()} == wanted


def test_fuzzy_pairs_with_repeated_words(spark):
    from uploadwatch.functions.text import token_set_similarity

    titles = ["bola bola bola bola", "bolaa", "liga liga liga final final", "ligaa finals", "x"]
    wanted = {(j, i) for i, t in enumerate(titles) for j, u in enumerate(titles) if i < j and token_set_similarity(t, u) >= config.FUZZY_THRESHOLD}
    assert {(1, 0), (3, 2)} <= wanted
    d = detections(spark, [(i, f"https://x/{i}", t) for i, t in enumerate(titles)])
    assert {(r.a, r.b) for r in cluster.fuzzy_edges(d).collect()} == wanted
    assert groups(cluster.deduplicate(d)) == [[0, 1], [2, 3], [4]]


def test_canonical_choice(spark):
    d = detections(spark, [(0, "u", "t", "c", "xx", "2"), (1, "u", "t", "c", "xxx", "3"), (2, "u", "t", "c", "xxx", "2"), (3, "u", "t", "c", "xxx", "2")])
    assert [r.seq for r in cluster.pick_canonical(d, ["url"]).collect()] == [2]
    chosen = cluster.clusters(cluster.deduplicate(d)).collect()
    assert [(r.seq, r.cluster_size, len(r.cluster_id)) for r in chosen] == [(2, 4, 16)]


def test_empty_input(spark):
    none = detections(spark, [])
    assert cluster.deduplicate(none).count() == 0 and cluster.clusters(cluster.deduplicate(none)).count() == 0


def test_merge_replay_keeps_size(spark):
    d = detections(spark, [(0, "https://x/1", "t", "c", "aa"), (1, "https://x/2", "t", "c", "b")]).withColumns({"cluster_id": F.lit("k"), "is_canonical": F.col("seq") == 0})
    again = cluster.merge(d, d.withColumn("snapshot_html", F.lit("much longer")))
    assert {(r.seq, r.is_canonical, r.cluster_size, r.snapshot_html) for r in again.collect()} == {(0, True, 2, "aa"), (1, False, 2, "b")}


def test_whitelist(spark):
    d = detections(spark, [(0, "u", "t", "good"), (1, "u", "t", "bad")])
    assert [r.seq for r in cluster.without_channels(d, spark.createDataFrame([("good",), ("good",)], "channel_id string")).collect()] == [1]


def test_expand(spark):
    titles = spark.createDataFrame([(0, "Film HD"), (1, "  "), (2, "film"), (3, "Other")], "seq bigint, title string")
    rows = [r.query for r in search.expand(titles).orderBy("rank").collect()]
    assert rows[:4] == ["film vidio", "film vidio.com", "other vidio", "other vidio.com"] and rows[4:6] == ["film", "other"] and len(rows) == 18
    assert search.expand(titles, max_queries=3).count() == 3
    assert [r.query for r in search.expand(titles, ("x",), 9).orderBy("rank").collect()] == ["film x", "other x", "film", "other"]


@pytest.mark.parametrize("points, verdict", [(100, "confirmed"), (80, "confirmed"), (79, "likely"), (60, "likely"), (59, "possible"), (25, "possible"), (24, "ignore"), (0, "ignore")])
def test_verdicts(spark, points, verdict):
    assert spark.range(1).select(score.verdict(F.lit(points))).first()[0] == verdict


def test_signals(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(score.repeat_points(F.lit(n))) for n in (0, 1, 2, 3, 4, 100)] == [0, 5, 10, 10, 15, 15]
    assert [one(score.engagement_points(F.lit(v), F.lit(a))) for v, a in ((10_000, 1), (10_000, 0), (1_000, 1), (100, 1), (99, 1), (20_000, 10))] == [10, 10, 7, 4, 0, 7]
    assert one(score.engagement_points(F.lit(None).cast("bigint"), F.lit(1))) == 0
    assert [one(score.watermark_points(F.lit(None).cast("boolean"), F.lit(h))) for h in ("x PLAYER.vidio.com and vidio-player", "vidio.com", "", None)] == [15, 7, 0, 0]
    assert one(score.watermark_points(F.lit(True), F.lit(""))) == 30
    assert [one(score.fingerprint_points(F.lit(x))) for x in ("confirmed", "likely", "none", None)] == [20, 10, 0, 0]
    assert [one(score.title_points(F.lit(t), F.lit(q), ["Liga Champions"])) for t, q in (("liga champions", ""), ("", "Champions Liga vidio"), ("nothing alike", ""), ("", ""), (None, None))] == [25, 25, 0, 0, 0]
    assert one(score.title_points(F.lit("x"), F.lit(""), [])) == 0
    assert sum(config.WEIGHTS.values()) == 100


def test_title_points_of_a_large_catalog(spark):
    from uploadwatch.functions.text import token_set_similarity

    rng = random.Random(8)
    words = [f"kata{i}" for i in range(60)] + ["liga", "cinta", "x"]
    known = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(260)] + ["derby paling akhir"]
    titles = [*rng.sample(known, 20), *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(40)), "Derby paling akhir", "derbi palin akir", "", None, "!!", "liga liga liga"]
    grade = lambda s: next((p for least, p in config.TITLE_GRADES if s >= least), 0)
    wanted = {i: grade(max(token_set_similarity(t.lower().strip("!"), k) for k in known)) if t else 0 for i, t in enumerate(titles)}
    assert wanted[60] == 25
    d = detections(spark, [(i, f"https://x/{i}", t) for i, t in enumerate(titles)])
    catalog = spark.createDataFrame([(k,) for k in known], "title string")
    assert {r.seq: r.points for r in score.with_title_points(d, catalog).collect()} == wanted
    done = score.scored(d, F.lit(0), catalog, "now")
    assert {r.seq: r.breakdown.title_keyword_match for r in done.collect()} == wanted and "_title_points" not in done.columns


EVIDENCE = "platform string, permanent_id string, display_name string, profile_url string, url string, detected_at string, seq bigint"


def test_registry(spark):
    first = spark.createDataFrame([("p", "1", "A", "u1", "v1", "2026-01-02", 0), ("p", "1", "B", "u2", "v2", "2026-01-01", 1), ("q", "1", "C", "u3", "v1", "2026-01-05", 2)], EVIDENCE)
    held = registry.upsert(registry.empty(spark), first)
    rows = {(r.platform, r.permanent_id): r for r in held.collect()}
    one = rows["p", "1"]
    assert (one.violation_count, one.tier, one.status, one.first_seen, one.last_seen, one.display_name, one.evidence_urls) == (2, "tier2", "active", "2026-01-02", "2026-01-02", "B", ["v1", "v2"])
    held = registry.update_status(held, "p", "1", "suspended", "now")
    again = registry.upsert(held, first)
    one = {(r.platform, r.permanent_id): r for r in again.collect()}["p", "1"]
    assert (one.violation_count, one.status, one.notes, one.evidence_urls) == (4, "suspended", "[now] active → suspended", ["v1", "v2"])
    assert {r.violation_count for r in registry.upsert(held, first, count_known_urls=False).collect()} == {1, 2}
    assert [r.platform for r in registry.prior_violations(again).collect()] == ["q"]
    assert registry.list_active(again, "p").count() == 0 and registry.lookup(again, "q", "1").count() == 1
    with pytest.raises(ValueError):
        registry.update_status(held, "p", "1", "gone", "now")
    with pytest.raises(KeyError):
        registry.update_status(held, "p", "9", "active", "now")
    with pytest.raises(KeyError):
        registry.export_for_legal(held, "9")
    assert '"violation_count":4' in registry.export_for_legal(again, "1").first().package


def test_registry_rows(spark):
    given = [("1", "p", "A", "u", "tier3", "", "", "a", "b", "", 2), ("1", "p", "B", "u", "tier1", "removed", "7", "a", "b", "n", 3), ("",) * 10 + (4,)]
    rows = spark.createDataFrame(given, schemas.REGISTRY_TABLE + ", sheet_row int")
    assert [(r.display_name, r.status, r.violation_count) for r in registry.from_rows(rows).collect()] == [("B", "removed", 7)]
    assert [(r.display_name, r.status, r.violation_count) for r in registry.from_rows(rows.filter("sheet_row = 2")).collect()] == [("A", "active", 0)]


def stats(spark, **values):
    base = {"detections_raw": 100, "clusters_after_dedup": 60, "confirmed_count": 1, "likely_count": 0, "possible_count": 0, "ignored_count": 0, "errors": [], "platforms_crawled": ["facebook"], "duration_seconds": 10.0, "sheet_write_errors": 0} | values
    return spark.createDataFrame([tuple(base[c] for c in schemas.names(schemas.STATS))], schemas.STATS)


@pytest.mark.parametrize("values, statuses, overall", [
    ({}, ["ok", "ok", "ok", "ok", "ok"], "healthy"), ({"clusters_after_dedup": 90}, ["ok"] * 5, "healthy"), ({"clusters_after_dedup": 91}, ["ok", "ok", "degraded", "ok", "ok"], "degraded"), ({"clusters_after_dedup": 30}, ["ok"] * 5, "healthy"),
    ({"clusters_after_dedup": 29}, ["ok", "ok", "degraded", "ok", "ok"], "degraded"), ({"detections_raw": 0, "clusters_after_dedup": 0}, ["critical", "ok", "skipped", "skipped", "ok"], "critical"), ({"sheet_write_errors": 1}, ["ok", "critical", "ok", "ok", "ok"], "critical"),
    ({"confirmed_count": 0}, ["ok", "ok", "ok", "degraded", "ok"], "degraded"), ({"duration_seconds": 3600.0}, ["ok"] * 5, "healthy"), ({"duration_seconds": 3601.0}, ["ok", "ok", "ok", "ok", "degraded"], "degraded"),
])
def test_health(spark, values, statuses, overall):
    found = health.checks(stats(spark, **values))
    assert [r.status for r in found.orderBy("position").collect()] == statuses
    assert health.overall(found).first()[0] == overall


def test_report_and_alerts(spark):
    sent = []
    out = health.report(stats(spark, detections_raw=0), "r1", "now", dispatch=sent.append)
    assert out["overall_status"] == "critical" and out["alerts_sent"] == ["dispatcher"] and sent[0]["attachments"]
    assert "text" in health.payload(out, "https://chat.googleapis.com/x") and "attachments" not in health.payload(out, "https://chat.googleapis.com/x")

    def fails(_):
        raise OSError

    assert health.report(stats(spark, detections_raw=0), "r1", "now", dispatch=fails)["overall_status"] == "critical"
    assert health.report(stats(spark), "r1", "now", dispatch=sent.append)["alerts_sent"] == [] and len(sent) == 1


def test_preflight():
    good = {"GOOGLE_SHEETS_ID": "x", "FB_COOKIE_FILE": "c", "SLACK_WEBHOOK_URL": "h"}
    assert health.preflight(good, lambda _: True)[0]
    assert health.preflight({k: v for k, v in good.items() if k != "SLACK_WEBHOOK_URL"}, lambda _: True)[0]
    assert not health.preflight({}, lambda _: True)[0] and not health.preflight(good, lambda p: p == "c")[0]


def test_files(spark, tmp_path):
    (tmp_path / "titles").write_text("# head\nFilm A\n\n  # kept\n  Film B  \n", encoding="utf-8")
    assert [r.title for r in files.titles(spark, str(tmp_path / "titles")).orderBy("seq").collect()] == ["Film A", "# kept", "Film B"]
    (tmp_path / "white").write_text("  c1 \n  # no\n\nc1\nc2\n", encoding="utf-8")
    assert sorted(r.channel_id for r in files.whitelist(spark, str(tmp_path / "white")).collect()) == ["c1", "c2"]
    assert files.whitelist(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "stats").write_text('{"detections_raw": 4, "unknown": 1}')
    assert (files.run_stats(spark, str(tmp_path / "stats")).first().detections_raw, files.run_stats(spark, str(tmp_path / "stats")).first().errors) == (4, [])
    with pytest.raises(FileNotFoundError):
        files.run_stats(spark, str(tmp_path / "absent"))


def test_run_twice(spark, tmp_path):
    d = detections(spark, [(0, "https://www.facebook.com/watch?v=1", "Liga Champions", "77", "vidio.com vidio-player player.vidio.com"), (1, "https://www.facebook.com/watch?v=2", "Cooking", "78")])
    flagged = d.withColumn("extra", F.struct(F.lit(10**6).cast("bigint").alias("view_count"), F.lit(None).cast("int").alias("duration_secs"), F.lit(True).alias("content_id_match"), F.lit("confirmed").alias("fingerprint_match_level"), F.lit(1).alias("account_age_days")))
    none = spark.createDataFrame([], "channel_id string")
    first = run.run(flagged, none, ["Liga Champions"], "2026-01-01T00:00:00Z")
    assert {(r.url[-1], r.score, r.verdict) for r in first.evidence.collect()} == {("1", 85, "confirmed"), ("2", 60, "likely")}
    store = tables.Table(spark, str(tmp_path / "t"), schemas.DETECTIONS_TABLE)
    store.write(first.detections)
    store.write(tables.update_detection_status(store.read(), store.read().first().cluster_id, "reviewed", "note"))
    second = run.run(flagged, none, ["Liga Champions"], "2026-01-02T00:00:00Z", first.registry, store.read())
    assert {r.violation_count for r in second.registry.collect()} == {2} and second.detections.count() == 2
    assert {r.status for r in second.detections.collect()} == {"reviewed", "new"} and {r.score for r in second.evidence.collect()} == {90, 65}
    assert tables.inserted(store.read(), second.detections) == 0
    with pytest.raises(KeyError):
        tables.update_detection_status(store.read(), "nothing", "x")
    assert first.stats.first().detections_raw == 2
    dry = run.run(flagged, spark.createDataFrame([("77",)], "channel_id string"), [], "now", dry_run=True)
    assert dry.registry.count() == 0 and (dry.stats.first().detections_raw, dry.stats.first().clusters_after_dedup) == (2, 1)


def test_run_log(spark):
    row = tables.run_log_row(stats(spark, errors=["a", "b"]), "r", "2026-01-01T00:00:00Z", "2026-01-01T00:01:30Z").first()
    assert (row.duration_seconds, row.errors, row.detections_found) == (90.0, "a; b", 100)
    assert tables.run_log_row(stats(spark), "r", "never", "2026-01-01T00:01:30Z").first().duration_seconds is None


def test_stream(spark, tmp_path):
    from uploadwatch.streaming import watch

    page = '<a href="/reel/1234567/" title="Liga Champions">x</a>'
    spark.createDataFrame([("q", page, 1)], "query string, html string, seq bigint").selectExpr("*", "timestamp '2026-01-01' as crawled_at").write.parquet(str(tmp_path / "pages"))
    held = {n: tables.Table(spark, str(tmp_path / n), s) for n, s in (("d", schemas.DETECTIONS_TABLE), ("r", schemas.OFFENDER))}
    q = watch.keep_tables(watch.page_stream(spark, str(tmp_path / "pages")), held["d"], held["r"], ["Liga Champions"], spark.createDataFrame([], "channel_id string"), "now", str(tmp_path / "check"))
    q.awaitTermination()
    assert [(r.content_title, r.verdict) for r in held["d"].read().collect()] == [("Liga Champions", "possible")]
    again = [(r.content_title, r.violation_count) for r in held["d"].read().collect()]
    number = held["d"]._versions()[-1][2]
    assert number >= 0 and held["d"].holds(held["d"]._versions()[-1][1], number) and held["r"].holds(held["r"]._versions()[-1][1], number)
    q = watch.keep_tables(watch.page_stream(spark, str(tmp_path / "pages")), held["d"], held["r"], ["Liga Champions"], spark.createDataFrame([], "channel_id string"), "now", str(tmp_path / "check"))
    q.awaitTermination()
    assert [(r.content_title, r.violation_count) for r in held["d"].read().collect()] == again


def test_late_pages_of_a_stream(spark, tmp_path):
    from uploadwatch.streaming import watch

    for day, number in ((20, 1), (1, 2), (20, 1)):  # the second comes nineteen days late
        page = f'<a href="/reel/123456{number}/" title="Title {number} here">x</a>'
        spark.createDataFrame([("q", page, number)], "query string, html string, seq bigint").selectExpr("*", f"timestamp '2026-01-{day:02d}' as crawled_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        q = watch.first_detections(watch.page_stream(spark, str(tmp_path / "pages")), "now").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.url[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]


def test_bad_pages_cost_themselves(spark, recwarn):
    from uploadwatch.sources import crawl

    card = '<div class="bstar-video-card"><a href="/video/{0}"><img alt="Film {0}"></a></div>'
    pages = [("q1", '<a href="http://[x">?</a>' + card.format(10**9), 7), ("q1", card.format(10**9 + 1), 1 << 50), ("q2", None, 3), ("q2", "", 4), (None, card.format(10**9 + 2), 5)]
    social = [("q1", None, 1), ("q3", '<a href="/reel/1234567/" title="Some title">x</a>' * 3, 2)]
    frames = {p: spark.createDataFrame(rows, "query string, html string, seq bigint") for p, rows in (("bilibili", pages), ("facebook", social))}
    found, lost = crawl.crawl(frames, "now", ["facebook", "bilibili"])
    assert [(r.seq, r.title) for r in found.orderBy("seq").collect()] == [(0, "Some title"), (1, "Film 1000000002"), (2, "Film 1000000000"), (3, "Film 1000000001")]
    told = sorted(tuple(r) for r in lost.collect())
    assert [t[:3] for t in told] == [("bilibili", "q1", 7), ("bilibili", "q2", 3), ("facebook", "q1", 1)] and "http://[x" in told[0][3] and told[1][3] == crawl.NO_PAGE
    assert found.columns == [f.split()[0] for f in ("platform", "url", "title", "channel_id", "channel_name", "snapshot_html", "detected_at", "query_used", "extra", "seq")]


def test_failing_queries_cost_themselves(spark, monkeypatch, recwarn):
    from uploadwatch.sources import crawl

    def fragile(pages, run_ts, max_results=None):
        checked = pages.withColumn("html", F.when(F.col("html") == "bad", F.raise_error(F.concat(F.lit("cannot read "), "query"))).otherwise(F.col("html")))
        return crawl.social_detections(checked, run_ts, max_results)

    monkeypatch.setitem(crawl.PLATFORMS, "fragile", fragile)
    good = '<a href="/reel/12345{0:02d}/" title="Title {0}">x</a>'
    rows = [(f"q{k}", "bad" if k in (3, 8) else good.format(k), k) for k in range(12)]
    found, lost = crawl.crawl({"fragile": spark.createDataFrame(rows, "query string, html string, seq bigint")}, "now", ["fragile"])
    assert sorted(r.query_used for r in found.collect()) == sorted(f"q{k}" for k in range(12) if k not in (3, 8))
    assert sorted((r.platform, r.query, r.page_seq) for r in lost.collect()) == [("fragile", "q3", None), ("fragile", "q8", None)] and all(r.message for r in lost.collect())


def test_failing_platform(spark, monkeypatch, recwarn):
    from uploadwatch.sources import crawl

    def broken(pages, run_ts, max_results=None):
        raise ValueError("no page")

    monkeypatch.setitem(crawl.PLATFORMS, "broken", broken)
    page = spark.createDataFrame([("q", '<a href="/reel/1234567/" title="Some title">x</a>', 1)], "query string, html string, seq bigint")
    errors = []
    found = crawl.crawl_all({"broken": page, "facebook": page}, "now", ["broken", "facebook"], errors=errors).collect()
    assert [r.title for r in found] == ["Some title"] and errors == ["broken, query 'q': ValueError: no page"]
    assert crawl.crawl_all({"facebook": page}, "now", ["bilibili"]).count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from uploadwatch.__main__ import main

    page = '<a href="/reel/1234567/" title="Liga Champions">x</a>'
    spark.createDataFrame([("q", page, 1)], "query string, html string, seq bigint").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "titles.txt").write_text("# titles\nLiga Champions\n")
    given = ["run", "--pages", f"facebook={tmp_path / 'pages'}", "--titles", str(tmp_path / "titles.txt"), "--whitelist", str(tmp_path / "none.txt"), "--tables", str(tmp_path / "tables"), "--stats", str(tmp_path / "stats")]
    assert main(given, spark) == 0 and main(given, spark) == 0
    log = tables.Log(spark, str(tmp_path / "tables" / "log"), schemas.RUN_LOG).read().collect()
    assert [r.detections_found for r in log] == [1, 1]
    assert tables.Table(spark, str(tmp_path / "tables" / "detections"), schemas.DETECTIONS_TABLE).read().count() == 1
    capsys.readouterr()
    assert main(["canary", "--stats", str(tmp_path / "stats")], spark) == 1  # one row cannot be a duplicate, which is below the expected ratio
    assert '"overall_status": "degraded"' in capsys.readouterr().out
    for name in ("GOOGLE_SHEETS_ID", "FB_COOKIE_FILE"):
        monkeypatch.delenv(name, raising=False)
    assert main(["preflight"]) == 1


def test_same_identity(spark):
    from uploadwatch.operators import identity as who

    kind = "struct<platform:string,permanent_id:string>"
    rows = spark.createDataFrame([(("a", "1"), ("a", "1")), (("a", "1"), ("b", "1")), (("a", "1"), ("a", "2"))], f"x {kind}, y {kind}")
    assert [r[0] for r in rows.select(who.same_identity(F.col("x"), F.col("y"))).collect()] == [True, False, False]
