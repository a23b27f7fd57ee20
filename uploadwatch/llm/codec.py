"""Tokenizer access that stays exact while most of a text is looked up instead of encoded.

A byte-level BPE encodes each pre-token for itself.  Texts of common characters are split by the public
pattern; their pre-tokens repeat, so ids are kept in a bounded dictionary and only unseen pre-tokens go to
the library's model.  Of other texts, pieces are: a pre-token always starts at a single space between two
non-space characters, so a text can be cut there.  Pieces with special tokens or uncommon characters go
through the whole library, and other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

PIECE_LIMIT = 128  # longer pieces are worked out each time
CACHE_LIMIT = 600_000  # entries of a dictionary, some 150 bytes each
_ODD = "\u180e\u200b\u2060\ufeff"  # white space to some Unicode versions only
SAFE_CUT = re.compile(rf"(?<=[^\s{_ODD}]) (?=[^\s{_ODD}])")


def tokenizer_path(name: str) -> str:
    """A path as given, or a file of the installed public tokenizers by its name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """Code points that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 up."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class Kept(dict):
    """A dictionary that works out what it lacks and never outgrows its limit: once half full it starts anew, and what was used of the last half stays."""

    def __init__(self, work_out: Callable):
        super().__init__()
        self.work_out = work_out
        self.last: dict = {}
        self.limit = CACHE_LIMIT

    def __missing__(self, key: str):
        value = self.last.get(key)
        if value is None:
            value = self.work_out(key)
        if len(key) <= PIECE_LIMIT:
            if len(self) >= self.limit // 2:
                self.last = dict(self)
                self.clear()
            self[key] = value
        return value


#: Below U+0250 all Unicode versions class characters alike; of white space these texts hold spaces and line ends only.
_COMMON = re.compile("[\n -~\u00a1-\u00ac\u00ae-\u024f]*").fullmatch
_LETTER, _NUMBER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The public pre-token pattern over such texts.
_SPLIT_COMMON = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+").findall


class PieceMap:
    """Maps texts to bytes, piece by piece: word for each pre-token, whole for what needs its surroundings."""

    def __init__(self, word: Callable[[str], bytes], whole: Callable[[str], bytes], context: str):
        """context: a pattern of what only whole maps rightly."""
        import regex
        from public_tokenizers import PATTERN

        self.split = regex.compile(PATTERN).findall
        self.words, self.whole = Kept(word), whole
        self.context = re.compile(context).search
        self.pieces = Kept(self._piece)

    def part(self, text: str) -> bytes:
        """A text that starts and ends where a pre-token may."""
        if _COMMON(text) and not self.context(text):
            words = self.words
            return b"".join([words[w] for w in _SPLIT_COMMON(text)])
        return self.whole(text)

    def _piece(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace() or piece[0] in _ODD or piece[-1] in _ODD:
            return None
        return self.part(" " + piece)

    def of(self, text: str) -> bytes:
        if _COMMON(text) and not self.context(text):
            return b"".join(map(self.words.__getitem__, _SPLIT_COMMON(text)))
        head, *rest = text.split(" ")
        found = list(map(self.pieces.__getitem__, rest))
        if None not in found and not head[-1:].isspace() and head[-1:] not in tuple(_ODD):
            return self.part(head) + b"".join(found)
        parts = SAFE_CUT.split(text)
        if len(parts) == 1:
            return self.part(text)
        return self.part(parts[0]) + b"".join(map(self.pieces.__getitem__, parts[1:-1])) + self.part(" " + parts[-1])


class Codec:
    """ids of texts under one tokenizer file, as little-endian arrays."""

    def __init__(self, path: str):
        self.path = path
        self.map: PieceMap | None = None
        if path.endswith(".model"):
            import sentencepiece

            self.piece_model = sentencepiece.SentencePieceProcessor(model_file=path)
            size = self.piece_model.get_piece_size()
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.piece_model = None
            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            size = self.library.get_vocab_size(with_added_tokens=True)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.special = [t["content"] for t in spec.get("added_tokens", [])]
            pre = spec.get("pre_tokenizer") or {}
            if (
                spec.get("normalizer") is None
                and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True)
                and not pre.get("add_prefix_space")
                and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", []))
            ):
                letters = byte_letters()
                tokenize, plain = self.library.model.tokenize, re.compile(" [!-~]+").fullmatch
                self.map = PieceMap(
                    lambda word: self.pack([t.id for t in tokenize("\u0120" + word[1:] if plain(word) else word.encode().decode("latin-1").translate(letters))]),
                    lambda text: self.direct([text])[0],
                    "|".join(map(re.escape, self.special)) or "(?!)",
                )
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def pack(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little":
            return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()
        return np.array(ids, self.dtype).tobytes()

    def direct(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        if self.piece_model is not None:
            return list(map(self.pack, self.piece_model.encode(texts, num_threads=1)))
        return [self.pack(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The bytes of each text's ids."""
        return self.direct(texts) if self.map is None else list(map(self.map.of, texts))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def decode_texts(column) -> list[str]:
    """Texts of an Arrow binary column; bytes that are no UTF-8 become U+FFFD."""
    return [b.decode("utf-8", "replace") for b in column.to_pylist()]
