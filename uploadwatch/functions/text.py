"""Canonical titles, durations and similarity."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uploadwatch import config


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def composed(text: Column) -> Column:
    """NFKC.  Spark has no built-in, and ASCII needs none: only other texts cross to Python."""
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, _nfkc(F.when(beyond, text))).otherwise(text)


def canonical(text: Column, compose: bool = True) -> Column:
    """Lower-case words of a-z and 0-9 with evasive spellings undone and stop words left out; null becomes ''."""
    plain = F.translate(F.lower(composed(text) if compose else text), "".join(config.LEET), "".join(config.LEET.values()))
    words = F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*config.STOPWORDS))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def duration_seconds(text: Column) -> Column:
    """H:MM:SS or MM:SS in seconds, else null."""
    parts = F.transform(F.split(stripped(text), ":"), lambda p: stripped(p).try_cast("int"))
    known = ~F.exists(parts, lambda p: p.isNull())
    total = F.when(F.size(parts) == 3, parts[0] * 3600 + parts[1] * 60 + parts[2]).when(F.size(parts) == 2, parts[0] * 60 + parts[1])
    return F.when(text.isNotNull() & known, total)


_CODES = np.full(256, 37, np.uint8)
_CODES[[*b"abcdefghijklmnopqrstuvwxyz0123456789 "]] = np.arange(37)
_LIMB = 64


def common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of canonical titles: 64 letters at a time, all pairs at once."""
    out = np.zeros(len(left), np.int64)
    sizes = np.array([len(x) for x in left], np.int64)
    limbs = -(-sizes // _LIMB)
    for n in np.unique(limbs[limbs > 0]):  # pairs of like length, so none carries the longest one's limbs
        at = np.flatnonzero(limbs == n)
        out[at] = _common_lengths([left[i] for i in at], [right[i] for i in at], int(n))
    return out


def common_length(a: str, b: str) -> int:
    return int(common_lengths([a], [b])[0])


def _common_lengths(left: list[str], right: list[str], limbs: int) -> np.ndarray:
    codes = lambda texts: _CODES[np.array([t.encode() for t in texts], f"S{max(1, *map(len, texts))}").view(np.uint8).reshape(len(texts), -1)]
    a, b = codes(left), codes(right)
    rows = np.arange(len(left))
    places = np.zeros((38, limbs, len(left)), np.uint64)
    for i in range(a.shape[1]):
        places[a[:, i], i // _LIMB, rows] |= np.uint64(1 << i % _LIMB)
    places[37] = 0  # what pads a title meets nothing
    sizes = np.array([len(x) for x in left], np.int64)
    full = np.array([[(1 << min(max(int(n) - k * _LIMB, 0), _LIMB)) - 1 for n in sizes] for k in range(limbs)], np.uint64)
    open_ = full.copy()
    for j in range(b.shape[1]):
        carry = np.uint64(0)
        for k in range(limbs):
            own = open_[k]
            met = own & places[b[:, j], k, rows]
            total = own + met
            over = total < own
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            open_[k] = (total | (own - met)) & full[k]
    return sizes - np.bitwise_count(open_).sum(axis=0).astype(np.int64)


def token_set_similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Of pairs of canonical titles, from 0 to 1 and whatever the order of words.

    With the common words c and what each side has besides: 1 if a side has nothing besides, else the best
    ratio of equal letters among c + left, c + right, and c with either (c leads both, so lengths give that).
    """
    out, open_, cx, cy = np.zeros(len(left)), [], [], []
    for i, (a, b) in enumerate(zip(left, right)):
        if not a or not b:
            out[i] = float(a == b)
            continue
        x, y = set(a.split()), set(b.split())
        common = x & y
        if common and (len(common) == len(x) or len(common) == len(y)):
            out[i] = 1.0
            continue
        c, x, y = (" ".join(sorted(s)) for s in (common, x - common, y - common))
        if c:
            out[i] = 2 * len(c) / (len(c) + len(c) + 1 + min(len(x), len(y)))
            x, y = f"{c} {x}", f"{c} {y}"
        if 2 * min(len(x), len(y)) > out[i] * (len(x) + len(y)):
            open_.append(i)
            cx.append(x)
            cy.append(y)
    if open_:
        sizes = np.array([len(x) + len(y) for x, y in zip(cx, cy)])
        out[open_] = np.maximum(out[open_], 2 * common_lengths(cx, cy) / sizes)
    return out


def token_set_similarity(a: str, b: str) -> float:
    return float(token_set_similarities([a], [b])[0])


@F.pandas_udf(T.DoubleType())
def similarity_of_canonical(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(token_set_similarities([x or "" for x in a], [x or "" for x in b]), dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_similarity(title: pd.Series, catalog: pd.Series) -> pd.Series:
    """The highest similarity of a canonical title with any of a list."""
    known: dict[str, float] = {}
    out = []
    for t, options in zip(title, catalog):
        if t not in known:
            known[t] = float(token_set_similarities([t or ""] * len(options), list(options)).max(initial=0.0))
        out.append(known[t])
    return pd.Series(out, dtype="float64")


#: Letters that are counted together: what two titles share of each bounds their common subsequence.
LETTERS = (*"abcdefghijklmnopqrstuvwxyz ", "0123456789")


def letter_counts(words: Column) -> Column:
    """size, and how often each of LETTERS stands in the sorted words, as a struct."""
    said = F.array_join(F.array_sort(words), " ")
    return F.struct(F.length(said).alias("size"), *((F.length(said) - F.length(F.translate(said, c, ""))).cast("smallint").alias(f"n{k}") for k, c in enumerate(LETTERS)))


def may_reach(a: Column, b: Column, words_a: Column, words_b: Column, least: float) -> Column:
    """Whether titles with these letter counts may be as similar as least; false only for those that cannot be."""
    shared = sum((F.least(a[f"n{k}"], b[f"n{k}"]).cast("int") for k in range(len(LETTERS))), F.lit(0))
    share = least / (2 - least)  # of the shorter of two texts in the longer, where the shorter is all they have in common
    common = F.length(F.array_join(F.array_intersect(words_a, words_b), " "))
    led = F.arrays_overlap(words_a, words_b) & (common >= F.least(a["size"], b["size"]) * share - 1e-6)
    # Words in common stand first on both sides, so the order of letters may gain a space at most.
    return (2 * (shared + 1) >= (a["size"] + b["size"]) * least - 1e-6) | led


def similarity(a: Column, b: Column) -> Column:
    return similarity_of_canonical(canonical(a), canonical(b))
