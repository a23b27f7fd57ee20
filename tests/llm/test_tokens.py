"""Token counts, the token store and packing, against the library and brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uploadwatch.llm import packing, store, tokens
from uploadwatch.llm.codec import codec, tokenizer_path
from uploadwatch.scratch import scratch_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", "a  b", "a   \n b ", "it's we're they've I'll don't", "x\n\ny", "<|endoftext|> hi <|endoftext|>", "  lead", "trail  ", "é ü 漢字 テスト 😀😀", "\u200b a  b\u3000 c", "a" * 300, "\n \n", "we'r 'v 'l", "\tx\ty  z", "a <|endoftext|>b", "ab\x1c cd \x85 e", "12345 67 ½ ²"]
DOCS = "doc_id bigint, text string, doc string, n_tokens string"  # the last two clash with names of results


def library(text):
    return codec(PATH).library.encode(text or "", add_special_tokens=False).ids


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], DOCS)


ROWS = [*enumerate(ODD), (100, None), (None, "null id"), (101, "same row"), (101, "same row"), (101, "same id"), (102, "word " * 3000)]


@pytest.mark.parametrize("text", ODD)
def test_prefix_counts(text):
    table = tokens.counter(PATH).table(text)
    assert [tokens.count_at(table, p) for p in range(len(text) + 1)] == [len(library(text[:p])) for p in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'srevl 01\n\t.,é漢\u00a0<|"), max_size=24))
def test_prefix_counts_of_any_text(text):
    table = tokens.counter(PATH).table(text)
    assert [tokens.count_at(table, p) for p in range(len(text) + 1)] == [len(library(text[:p])) for p in range(len(text) + 1)]
    assert np.frombuffer(codec(PATH).encode([text])[0], codec(PATH).dtype).tolist() == library(text)
    for budget in (0, 1, 3):
        cut = tokens.longest_within(table, budget)
        assert cut == max(p for p in range(len(text) + 1) if len(library(text[:p])) <= budget)


def test_token_counts(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.prefix_tables(docs(spark, ROWS)).collect())
    assert got == sorted((i is None, i or 0, len((t or "").encode()), len(library(t)), len(library(t)) > 1024) for i, t in ROWS)
    assert tokens.prefix_tables(docs(spark, [])).count() == 0


def test_other_tokenizers(spark):
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        path = tokenizer_path(name)
        direct = [len(x) // codec(path).dtype.itemsize for x in codec(path).direct([t or "" for _, t in ROWS])]
        assert sorted(r.n_tokens for r in tokens.token_counts(docs(spark, ROWS), name).collect()) == sorted(direct)


def test_store_round_trip(spark):
    rng = random.Random(2)
    passage = " ".join(f"word{rng.randrange(500)}" for _ in range(900))
    rows = ROWS + [(200 + k, f"{k} " + passage + f" tail {k}") for k in range(4)]
    path = scratch_path(spark, "store-test")
    store.write_store(docs(spark, rows), path)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in store.read_documents(spark, path).collect()}
    assert len(got) == len(rows)
    streams = sorted(((i is not None, i or 0), tuple(library(t) + [0])) for i, t in rows)
    at, wanted = 0, {}
    for (_, i), ids in streams:
        wanted.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4"))))
    for key in sorted(got, key=lambda k: k[1]):
        assert key[1] == at
        at += got[key][0]
        wanted[key[0] or 0].remove(got[key])
    assert not any(wanted.values())
    starts = [k[0] is not None and k[0] for k in sorted(got, key=lambda k: k[1])]
    assert starts == sorted(starts)
    back = {r.doc_id: r.ids for r in store.read_ids(spark, path, [0, 200, 102]).collect()}
    assert back == {0: [0], 200: library(rows[-4][1]) + [0], 102: library("word " * 3000) + [0]}
    pool = spark.read.parquet(f"{path}/pool").filter("kind = 0")
    assert pool.count() == pool.select("address").distinct().count()  # each chunk is stored once
    chunks = sum(len(r.sizes) for r in store.read_recipes(spark, path).collect())
    assert pool.count() < chunks  # and shared passages are shared


def test_damage_is_found(spark):
    path = scratch_path(spark, "store-damaged")
    store.write_store(docs(spark, [(1, "some text"), (2, "more")]), path)
    pool = spark.read.parquet(f"{path}/pool").cache()
    pool.count()
    pool.selectExpr("address", "doc_id", "n_tokens", "addresses", "sizes", "case when ids is null then null else concat(ids, cast('xx' as binary)) end as ids", "kind").write.partitionBy("kind").mode("overwrite").parquet(f"{path}/pool2")
    import shutil

    shutil.rmtree(f"{path}/pool".removeprefix("file://"))
    shutil.move(f"{path}/pool2".removeprefix("file://"), f"{path}/pool".removeprefix("file://"))
    with pytest.raises(Exception, match="does not match its address"):
        store.read_documents(spark, path).collect()


@pytest.mark.parametrize("lost", ["chunk", "recipe", "manifest", "number"])
def test_losses_are_found(spark, lost):
    import shutil

    path = scratch_path(spark, "store-lost")
    store.write_store(docs(spark, [(1, "some text"), (2, "more"), (3, None)]), path)
    assert store.read_documents(spark, path).count() == 3
    folder, keep = {"chunk": ("pool/kind=0", "ids <> unhex('0000')"), "recipe": ("recipes", "doc_id <> 2"), "manifest": ("manifest", "false"), "number": ("recipes", "true")}[lost]
    kept = spark.read.parquet(f"{path}/{folder}").filter(keep)
    kept.selectExpr(*(f"{c} + 1 as {c}" if lost == "number" and c == "doc_id" else c for c in kept.columns)).write.parquet(f"{path}/kept")
    shutil.rmtree(f"{path}/{folder}".removeprefix("file://"))
    shutil.move(f"{path}/kept".removeprefix("file://"), f"{path}/{folder}".removeprefix("file://"))
    with pytest.raises(Exception, match="chunk is missing" if lost == "chunk" else "do not match the manifest"):
        store.read_documents(spark, path).collect()


def test_manifest_is_a_tree(spark, monkeypatch):
    monkeypatch.setattr(store, "PART", 4)
    monkeypatch.setattr(store, "FAN", 3)
    path = scratch_path(spark, "store-tree")
    store.write_store(docs(spark, [(k, "word " * (k % 7)) for k in range(60)]), path)
    nodes = spark.read.parquet(f"{path}/manifest").collect()
    top = max(n.level for n in nodes)
    assert top > 2 and [n.documents for n in nodes if n.level == top] == [60] and sum(n.documents for n in nodes if n.level == 0) == 60
    spark.read.parquet(f"{path}/recipes").repartition(5).write.parquet(f"{path}/again")
    assert {tuple(r) for r in store.merkle(spark.read.parquet(f"{path}/again")).collect()} == {tuple(n) for n in nodes}  # however files are split
    assert store.read_documents(spark, path).count() == 60


def test_moved_checksums():
    rng = np.random.default_rng(4)
    for after in (0, 1, 2, 255, 256, 70_000):
        data = rng.integers(0, 256, 40, np.uint8).tobytes()
        tail = rng.integers(0, 256, 4 * after, np.uint8).tobytes()
        assert zlib.crc32(data + tail) == int(store._shifted(np.array([zlib.crc32(data)]), np.array([after]))[0]) ^ zlib.crc32(tail)


def test_empty_store(spark):
    assert store.store_and_read(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 9)), min_size=1, max_size=9, unique_by=lambda x: x[0]), st.integers(1, 4))
def test_boundaries_are_best(histogram, buckets):
    from itertools import combinations

    histogram.sort()
    lengths, counts = [list(c) for c in zip(*histogram)]

    def waste(ends):
        return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram)

    options = [(*c, lengths[-1]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k)]
    found = packing.boundaries(lengths, counts, buckets)
    assert len(found) <= buckets and found[-1] == lengths[-1] and waste(found) == min(map(waste, options))


def test_pack(spark):
    rng = random.Random(1)
    rows = ROWS + [(300 + k, "word " * rng.randrange(1, 1500)) for k in range(60)]
    got = packing.pack(docs(spark, rows), buckets=4, budget=2048).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library(t)) for _, t in rows)
    batches = {}
    for r in got:
        assert r.padding == r.bucket - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) and len(p) <= max(1, 2048 // b) for (b, _), p in batches.items())
    assert len({b for b, _ in batches}) <= 4
    for b in {b for b, _ in batches}:  # only the last batch of a bucket may have room
        sizes = [len(batches[k]) for k in sorted(k for k in batches if k[0] == b)]
        assert all(s == max(1, 2048 // b) for s in sizes[:-1])
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_of_long_documents_by_brute_force(spark):
    import itertools

    rows = [(i, "a " * n) for i, n in enumerate([1, 700, 1025, 1027, 1100, 1303, 2049, 2055, 2900, 3001])]
    got = packing.pack(docs(spark, rows), buckets=3).collect()
    sizes = sorted(r.n_tokens for r in got)
    assert sum(n > 1024 for n in sizes) > 5
    least = min(sum(min(e for e in (*ends, sizes[-1]) if e >= n) - n for n in sizes) for ends in itertools.combinations(sizes[:-1], 2))
    assert sum(r.padding for r in got) == least and max(r.bucket for r in got) == sizes[-1]
