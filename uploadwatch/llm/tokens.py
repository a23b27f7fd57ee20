"""Token counts (3): the exact token count of every prefix of a text, by dynamic programming.

For a byte-level BPE the encoding of a prefix ends in exactly one token t, and what precedes t is the
encoding of a shorter prefix.  So ``last[i]`` is the one token ending at byte i that is compatible with
``last[i - len(t)]`` (encoding the two tokens' bytes gives the two tokens back), and
``count[i] = count[i - len(t)] + 1``.  Each distinct piece of text is solved once per worker; a text's
table is the concatenation of its pieces' differences, one signed 16-bit number per character.  Sums of
the table answer "how many tokens has text[:p]" and "what is the longest prefix of at most B tokens"
without encoding anything again.

Cases: null and empty texts have 0 tokens and an empty table; repeated rows are counted each for itself;
rows whose id is null stay; further columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.codec import CACHE_LIMIT, Codec, Kept, PieceMap, byte_letters, codec, decode_texts, tokenizer_path
from uploadwatch.llm.common import map_batches, text_bytes

DELTA = np.dtype("<i2")
TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
WORDS = 1_500_000  # words whose tables a worker remembers; working out new ones takes most of the time


class PrefixCounter:
    """Prefix tables under one byte-level BPE file."""

    def __init__(self, source: Codec):
        if source.map is None:
            raise ValueError(f"{source.path} is no byte-level BPE without normalizer")
        self.source = source
        with open(source.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = {chr(c): b for b, c in byte_letters().items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        raw = {t: bytes(map(letters.__getitem__, t)) for t in [*letters, *(a + b for a, b in pairs)]}
        # A token's number is the order in which merging makes it; single bytes come first.
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 256
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            pair = (self.number[raw[a]], self.number[raw[b]])
            if raw[a + b] not in self.number:
                self.number[raw[a + b]] = len(self.halves)
                self.halves.append(pair)
            self.joined.setdefault(pair, self.number[raw[a + b]])
        self.longest = max(map(len, self.number))
        self.fits: dict[tuple[int, int], bool] = {}
        self.map = PieceMap(lambda w: _differences(self.word(w)), lambda t: _differences(self.checked(t)), "|".join([_CONTEXT, *map(re.escape, source.special)]))
        self.map.words.limit = WORDS
        self.by_word = Kept(self.word)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to the two tokens.

        Merging joins across the border only if it can do so before a token is complete.  So take the token
        that was completed last apart, keep its half at the border, and see whether the border's neighbours
        of that earlier time have a merge that comes before what was taken apart.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) > 2 * CACHE_LIMIT:
            self.fits.clear()
        bound, fits = len(self.halves), True
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                fits = False
                break
            if left > right:
                if left < 256:
                    break
                bound, left = left, self.halves[left][1]
            else:
                if right < 256:
                    break
                bound, right = right + 1, self.halves[right][0]
        self.fits[key] = fits
        return fits

    def word(self, word: str) -> list[int]:
        """Counts at every character's end of one pre-token."""
        data = word.encode()
        size, get, longest, compatible = len(data), self.number.get, self.longest, self.compatible
        last, count = [-1] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is not None and (not start or compatible(last[start], token)):
                    last[end], count[end] = token, count[start] + 1
                    break
        if size == len(word):
            return count[1:]
        ends, at = [], 0
        for c in word:
            at += len(c.encode())
            ends.append(count[at])
        return ends

    def counts(self, words: list[str]) -> list[int]:
        """Counts at every character's end of a text, given as its pre-tokens.

        A prefix may be split otherwise than the whole: white space before its end is one run, and a
        contraction cut short is an apostrophe and a letter.
        """
        out: list[int] = []
        base, k = 0, 0
        while k < len(words):
            word = words[k]
            own = self.by_word[word]
            if word.isspace() and k + 1 < len(words) and words[k + 1][0].isspace():
                following = self.by_word[words[k + 1]]
                out += [base + n for n in self.by_word[word + words[k + 1][0]]]
                base += own[-1]
                out += [base + n for n in following[1:]]
                base += following[-1]
                k += 2
                continue
            if word in ("'re", "'ve", "'ll"):
                first = self.by_word["'"][-1]
                out += [base + first, base + first + self.by_word[word[1]][-1], base + own[-1]]
            else:
                out += [base + n for n in own]
            base += own[-1]
            k += 1
        return out

    def checked(self, text: str) -> list[int]:
        """Counts of any text; they end in the library's own count, whose pre-tokens stand where Unicode versions differ."""
        found = self._counts_with_special(text, self.map.split)
        if (found[-1] if found else 0) != len(self.source.direct([text])[0]) // self.source.dtype.itemsize:
            pre = self.source.library.pre_tokenizer.pre_tokenize_str
            found = self._counts_with_special(text, lambda part: [part[a:b] for _, (a, b) in pre(part)])
        return found

    def _counts_with_special(self, text: str, split: Callable[[str], list[str]]) -> list[int]:
        """A special token counts once it is complete; before that it is text like any other."""
        out: list[int] = []
        parts = re.split("(" + "|".join(map(re.escape, self.source.special)) + ")", text) if self.source.special else [text]
        for before, token in zip(parts[::2], [*parts[1::2], ""]):
            base = out[-1] if out else 0
            out += [base + n for n in self.counts(split(before + token))]
            if token:
                own = self.counts(split(before))
                out[-1] = base + (own[-1] if own else 0) + 1
        return out

    def table(self, text: str) -> bytes:
        """Differences of the counts, for each character of text."""
        return self.map.of(text)


#: White space runs, and contractions, whose prefixes are split in another way.
_CONTEXT = r"\s\s|'re|'ve|'ll"


def _differences(counts: list[int]) -> bytes:
    return array("h", map(sub, counts, [0, *counts])).tobytes() if sys.byteorder == "little" else np.diff(counts, prepend=0).astype(DELTA).tobytes()


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(codec(path))
    return _COUNTERS[path]


def count_at(table: bytes, prefix: int) -> int:
    """Tokens of the first ``prefix`` characters."""
    return int(np.frombuffer(table, DELTA)[:prefix].sum())


def longest_within(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    below = np.flatnonzero(np.cumsum(np.frombuffer(table, DELTA), dtype=np.int64) <= budget)
    return int(below[-1]) + 1 if len(below) else 0


def prefix_tables(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER, keep_table: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars (longest prefix of at most ``limit`` tokens) and, if kept, prefix_table."""
    path = tokenizer_path(tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        data = batch.column(1).to_pylist()
        tables = [count.table(b.decode("utf-8", "replace")) for b in data]
        totals = [count_at(t, len(t)) for t in tables]
        columns = [
            batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()),
            pa.array([len(t) // DELTA.itemsize if n <= limit else longest_within(t, limit) for t, n in zip(tables, totals)], pa.int64()),
        ]
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"]
        if keep_table:
            columns.append(pa.array(tables, pa.binary()))
            names.append("prefix_table")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint" + ", prefix_table binary" * keep_table
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), text_bytes()), run, schema)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens with any tokenizer file, by encoding."""
    path = tokenizer_path(tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        source = codec(path)
        ids = source.encode(decode_texts(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // source.dtype.itemsize for x in ids], pa.int64())], names=["doc_id", "n_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), text_bytes()), run, "doc_id bigint, n_tokens bigint")
