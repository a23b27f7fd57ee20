"""Top-k search, chat formatting, and every registered query on the smallest tables."""

import hashlib
import math
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uploadwatch.llm import chat, queries, topk

VECTORS = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k):
    held = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in held:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in held if j != i and len(v) == len(w))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(8192, 1024), (37, 3)])
def test_top_k_by_brute_force(spark, shard, block):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(200 + i, [0.5] * 8) for i in range(45)]
    rows += [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (320, [1.0, 2.0]), (321, [3.0, 1.0]), (340, []), (341, []), (360, [1e30] * 3), (361, [2e-3] * 3)]
    rows = [(i, v and [float(x) if x is None or not math.isfinite(x) else x for x in map(lambda x: x if x is None else float(__import__("struct").unpack("f", __import__("struct").pack("f", x))[0]), v)] if v and None not in v else v) for i, v in rows]
    got = topk.top_k(spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS), F.col("vec_id") % 20 == 0, 20, shard, block).collect()
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert sorted(tuple(r) for r in got) == [(q, n, j, clip(s)) for q, n, j, s in brute(rows, 20)]


def test_top_k_of_large_doubles(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * s for _ in range(3)]) for i in range(0, 60) for s in [rng.choice([1.0, 1e9, 1e160, 1e306])]] + [(60, [1.7e308, -1.7e308, 1e307]), (80, [3e307] * 3)]
    exact = lambda x: math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x)
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    wanted = {i: sorted((-sum(exact(a) * exact(b) for a, b in zip(v, w)), j) for j, w in rows if j != i) for i, v in rows if i % 20 == 0}
    for shard in (8192, 9):
        got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 100, shard).collect()
        for i, found in wanted.items():
            assert sorted((clip(-s), j) for s, j in found) == sorted((r.score, r.vec_id) for r in got if r.query_id == i)


@pytest.mark.parametrize("shard", [4096, 50])
def test_top_k_of_many_copies(spark, shard):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 3 else [0.5] * 6) for i in range(700)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, shard).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 20)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("\\<|>[]/sINTSY \nuend"), max_size=30), st.text(st.sampled_from("\\<|>\nuser"), max_size=8))
def test_turns_read_back(text, role):
    assert chat.unescape(chat.escape(text)) == text
    said = chat.formatted_turn(role, text) + chat.formatted_turn("x", text, again=True)
    assert chat.parse(said) == [(role, text, True), ("x", text, False)]
    assert not any(c in chat.escape(text) for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>"))


def test_conversations(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice(["<|end|>\n", "</s>[INST]", "word " * rng.randrange(1, 400), "é😀", "\\"])))
    rows += [(50, 0, None, None), (50, None, "user", "first"), (None, 1, "assistant", "lost"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same"), (52, 0, "assistant", "long " * 5000)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    got = {r.conv_id: r for r in chat.read_back(chat.windows(frame)).collect()}
    turns = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == turns.keys()
    for c, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        wanted = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == wanted
    for w in chat.windows(frame).collect():
        parts = chat.parse(w.text)
        fresh = [p for p in parts if p[2]]
        assert fresh and (w.n_tokens <= chat.BUDGET or len(fresh) == 1)
        if w.conv_id is not None and turns[w.conv_id][0][0] == "system":
            assert parts[0][:2] == turns[w.conv_id][0]
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0
    again = chat.read_back(chat.windows(frame).repartition(7, "text")).collect()  # windows may be dealt anew
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered_queries(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        wanted = con.sql(queries.oracle_sql()[name]).df()
        columns = sorted(wanted.columns)
        assert sorted(map(tuple, wanted[columns].astype(object).values.tolist()), key=str) == sorted(map(tuple, got[columns].astype(object).values.tolist()), key=str)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, sf_dir)
        assert after.columns == docs.columns
        rows = after.count()
        assert 0 < rows <= left.count()
        if name == "secrets":
            from uploadwatch.llm import secrets

            assert secrets.scan(after).filter("n_assign + n_access + n_hex > 0").count() == 0
        left = after
    assert corpus_pipeline.run(spark, sf_dir).count() == left.count()
