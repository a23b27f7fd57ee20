"""Ranked search, spelling variants and language-model scores against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from uploadwatch.llm import attention, lexical, lm, spelling

DOCS = "doc_id bigint, text string, term string, score string"  # the last two clash with names used inside
ITEMS = "item_id bigint, text string, doc_id string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def ranked(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in {(i, t) for i, t in items if t is not None}:
        asked[i].update(terms(t))
    out = []
    for item, query in asked.items():
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in query.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block, group", [(64, 200_000), (3, 60)])
def test_ranks_by_brute_force(spark, block, group):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÑU", "x9", "ΑΒ"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 20, 200]))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (None, docs[7][1]), (500, None), (501, ""), (502, " .,"), (503, "W1" * 9), (504, "w3 " * 400_000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(20)] + [(20, docs[7][1]), (21, None), (22, "--"), (23, "nothing here"), (24, "w1 w1 W1"), (24, "w1 w1 W1"), (24, "w4"), (None, "w5 w6")]
    got = lexical.rank(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, "z") for i in items], ITEMS), 20, block, group)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked(docs, items)


def test_ranks_of_nothing(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", "z")], ITEMS)
    assert lexical.rank(none, items).count() == 0
    assert lexical.rank(spark.createDataFrame([(1, "a", "x", "y")], DOCS), items.limit(0)).count() == 0


def test_bounds_leave_out_blocks(spark):
    """Rare words stand in few blocks; the others' bounds fall below the kth score and are not scored."""
    rng = random.Random(1)
    rows = []
    for b in range(200):
        docs = [Counter(["the"] * rng.randrange(1, 9) + (["rare"] if b < 3 else [])) for _ in range(30)]
        names = {"the": 0, "rare": 1}
        lists = [sorted((names[t], n) for t, n in c.items()) for c in docs]
        every = [x for own in lists for x in own]
        length = np.array([sum(c.values()) for c in docs])
        held = np.array(sorted({t for t, _ in every}))
        rows.append({
            "length": length, "n_terms": np.array(list(map(len, lists))), "term": np.array([t for t, _ in every]), "tf": np.array([n for _, n in every]), "held": held,
            "top_tf": np.array([max(n for t, n in every if t == h) for h in held]), "shortest": np.array([min(x for x, own in zip(length, lists) if any(t == h for t, _ in own)) for h in held]),
            "doc": np.stack([np.arange(30) + 30 * b, np.zeros(30, np.int64)], 1),
        })
    group, best = lexical._Group(rows, 2, 6000, sum(int(r["length"].sum()) for r in rows)), lexical._Best(20, 0)
    weights = np.array([lexical.weight(6000, 6000), lexical.weight(6000, 90)], np.int64)
    assert group.search(np.array([0, 1]), weights, np.zeros(2, np.int64), best) <= 3
    assert (best.doc[:, 0] < 90).all() and len(best.score) == 20


def edits_of(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def grouped(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", low(t)):
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    letters, forms = sorted({c for w in n for c in w}), {}
    near = {w: {x for x in edits_of(w, letters) if x in n and x != w} for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return Counter((w, forms[w], root(w), n[w], len(near[w]), n.get(forms[w])) for w in n)


def test_variants_by_brute_force(spark):
    rng = random.Random(3)
    base, letters = ["abcdef", "handel", "straße", "bananas", "ÉCOLES", "nañana", "aaaaaa", "q" * 300], "abcdezßÀÿ"
    words = list(base)
    for w in base:
        for _ in range(25):
            words.append(rng.choice(list(edits_of(low(w), letters))))
            words.append(rng.choice(list(edits_of(words[-1], letters))))
    spread = [w for k, w in enumerate(words) for _ in range(rng.choice([4, 5, 7, 30, 200]) if k >= len(base) else 1500 - 150 * (k % 3))]
    spread += [w for n in (5, 25, 125, 625) for w in ["x" * 7 + "y" * (n == 25) + "yz" * (n == 125) + "yzz" * (n == 625)] * n]  # a chain of forms
    rng.shuffle(spread)
    size = len(spread) // 200
    docs = [(k, "".join((w.upper() if rng.random() < 0.1 else w) + rng.choice([" ", ", ", "1", "œ", "\n"]) for w in spread[k * size : (k + 1) * size])) for k in range(201)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[8][1]), (None, "bananas " * 9), (300, None), (301, ""), (302, "a b 7"), (303, "handel " * 300_000)]
    got = spelling.variants(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = grouped(docs)
    assert any(f is not None and r != f for _, f, r, *_ in wanted) and any(k > 3 for *_, k, _ in wanted)
    assert Counter(map(tuple, got.collect())) == wanted


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_one_edit_leaves_a_band(spark):
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choice(spelling.LETTERS) for _ in range(rng.randrange(6, 12)))
        other = rng.choice(list(edits_of(word, spelling.LETTERS)))
        a, b = spelling.bands(word), spelling.bands(other)
        assert any(x == y for x, y in zip(a, b)) and sum(bin(x ^ y).count("1") for x, y in zip(a, b)) <= 2


def counted(docs):
    """What the base score needs, and its parts for each text."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in docs]
    c = Counter(w for own, out, (i, _) in zip(words, held, docs) if not out and i is not None for w in own)
    n, v = sum(c.values()), len(c)
    return [(i, out, len(own), sum(w in c for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) for (i, _), out, own in zip(docs, held, words)]


def spoken(n=160):
    rng = random.Random(12)
    parts = ["tion", "er", "ing", "é", "ou", "ba", "zz", "the", "an"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    docs = [(i, "".join(rng.choice(words[: 60 + 240 * (i % 2)]) + rng.choice([" ", " ", "\n", "\t\x0b", "\xa0"]) for _ in range(rng.choice([1, 8, 40, 150])))) for i in range(n)]
    return docs + [(3, docs[3][1]), (3, "other words"), (None, "one two three"), (500, None), (501, ""), (502, " \n "), (503, "Word " * 5000 + "longer " + "x" * 3000), (504, "<|endoftext|> The\x00END")]


def test_base_scores_and_chunks(spark):
    docs = spoken()
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3)
    runs = [lm.scores(frame, sample=150, **cut).collect() for cut in ({}, {"chunk": 700, "piece": 120})]
    for got in runs:
        assert got[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[-1])
        for have, want in zip(sorted((tuple(r[:6]) for r in got), key=key), sorted(counted(docs), key=key), strict=True):
            assert have[:5] == want[:5] and have[5] == pytest.approx(want[5], rel=1e-9)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = [r.score for r in runs[0] if (r.doc_id, r.n_tokens) == (3, next(x for x in counted(docs) if x[0] == 3)[2])]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])


def test_held_out_texts_score_better(spark, sf_dir):
    got = lm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), sample=3000).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.98 * sum(r.base_score for r in got) and sum(r.score > r.base_score for r in got) > 0.8 * len(got)


def test_all_learned_texts_teach(spark):
    order = "one two three four five six seven".split()
    docs = [(i, " ".join(order[(i + k) % 7] for k in range(100)), "x", "y") for i in range(2000)]
    got = lm.scores(spark.createDataFrame(docs, DOCS), sample=1, chunk=30_000).filter("held_out").collect()  # one window shows next to nothing of the order
    assert len(got) > 200 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_network_takes_a_place_a_word(spark):
    words = ["incomprehensibilities" * 3, "the", "x" * 500]  # many subwords each
    row = lm.chunks(spark.createDataFrame([(0, " ".join(words * 4), "x", "y"), (1, "", "x", "y")], DOCS).coalesce(1)).first().asDict()
    row |= {"n": np.array([4, 4, 4], "<i8").tobytes(), "entry": np.array([1, 2, lm.PLACES], "<u2").tobytes()}
    entries = attention.Vocabulary(np.arange(attention.KNOWN + 1), np.arange(attention.KNOWN + 1) % attention.CLASSES, np.zeros(attention.KNOWN + 1))
    own = lm._KnownChunk(row, entries, 2)
    assert [list(own.vocabulary.entry[s]) for s in own.streams([0, 1])] == [[0, *[1, 2, lm.PLACES] * 4, 0], [0, 0]]


def test_rare_words_join_groups_of_like_words():
    one, two = ["handed", "anders", "landing", "bandit"], ["queux", "lieux", "cieuxe", "mieux"]
    table = lm._table(one + two, np.array([3] * 4 + [5] * 4))
    assert list(lm._evidence(["stranded", "vieux", "and" * 9000], table).argmax(1)) == [3, 5, 3]
    alone = [lm._evidence([w], table)[0] for w in ("stranded", "vieux", "é")]
    assert np.allclose(lm._evidence(["stranded", "vieux", "é"], table), alone)  # nothing leaks from a word's neighbours


def test_scores_of_nothing(spark):
    assert lm.scores(spark.createDataFrame([], DOCS)).count() == 0
    alone = lm.scores(spark.createDataFrame([(None, "a b", "x", "y")], DOCS)).collect()
    assert [tuple(r[:6]) for r in alone] == [(None, False, 3, 0, 0, 0.0)] and alone[0].score < 0


def one_by_one(net, vocabulary, stream):
    """The log probability of each id after the first, one place at a time."""
    out, head = [], attention.WIDTH // attention.HEADS
    x = net["embed"][vocabulary.entry[stream[:-1]]].astype(np.float64)
    q, k, v = np.split(x @ net["qkv"], 3, 1)
    for i in range(len(x)):
        first = max(0, (i // attention.BLOCK - 1) * attention.BLOCK)
        mixed = []
        for h in range(attention.HEADS):
            part = slice(h * head, (h + 1) * head)
            s = np.array([q[i, part] @ k[j, part] / head**0.5 + net["bias"][h, i - j] for j in range(first, i + 1)])
            w = np.exp(s - s.max())
            mixed.append((w / w.sum()) @ v[first : i + 1, part])
        up = np.maximum((x[i] + np.concatenate(mixed) @ net["out"]) @ net["up"] + net["shift"], 0)
        logits = up @ net["down"] + net["base"]
        logits -= np.log(np.exp(logits - logits.max()).sum()) + logits.max()
        out.append(logits[vocabulary.leaves] + vocabulary.log_share)
        assert np.exp(out[-1]).sum() == pytest.approx(1, abs=1e-3)
    return [float(o[y]) for o, y in zip(out, stream[1:])]


def test_windows_score_each_id_once():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 300, n) for n in (2, 17, 33, 200, 3, 16)]
    counts = np.bincount(np.concatenate(streams), minlength=400).astype(float)
    vocabulary = attention.Vocabulary.of(counts, streams)
    net, losses = attention.fit(streams, vocabulary, 60)
    assert losses[-1] < 0.7 * losses[0]
    attention_batch, attention.SCORED_AT_ONCE = attention.SCORED_AT_ONCE, 5
    try:
        got = lm.Model(net, vocabulary, 399, 0.0).of_streams(streams)
    finally:
        attention.SCORED_AT_ONCE = attention_batch
    assert got == pytest.approx(np.concatenate([one_by_one(net, vocabulary, s) for s in streams]), abs=2e-3)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = {name: value.astype(np.float64) for name, value in attention.fresh(1).items()}
    entry, classes, opens, counted_ = rng.integers(0, 50, (6, attention.BLOCK)), rng.integers(0, attention.CLASSES, (6, attention.BLOCK)), np.array([1, 0, 0, 1, 0, 1], bool), rng.random((6, attention.BLOCK)) < 0.9
    _, found = attention.gradients(net, entry, classes, opens, counted_)
    for name, value in net.items():
        flat, own = value.reshape(-1), found[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(own) > 1e-6), 6):
            kept, sides = flat[i], []
            for e in (1e-5, -1e-5):
                flat[i] = kept + e
                sides.append(attention.gradients(net, entry, classes, opens, counted_)[0])
            flat[i] = kept
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(own[i], rel=1e-3, abs=1e-8)


def test_mixing_weight():
    by_model, frequency = np.log([0.4, 0.01, 0.5]), np.array([0.01, 0.3, 0.02])
    best = max(np.linspace(0.01, 0.99, 981), key=lambda w: np.log((1 - w) * np.exp(by_model) + w * frequency).sum())
    assert lm.mixing_weight(by_model, frequency, 2000) == pytest.approx(best, abs=2e-3)
