r"""Chat formatting (5): conversations as windows of bounded token counts, with a loss mask.

A turn becomes ``<|turn|>role\ntext<|end|>\n``; a turn repeated from an earlier window has ``<|again|>``
instead.  Inside roles and texts a backslash is doubled, and a control string gets one after its first
character, so no text can hold a marker and every text reads back exactly.

Prefix sums of the turns' tokens choose the windows: each takes as many new turns as the budget holds, after
the system turn (if the conversation starts with one) and as many whole turns of history as HISTORY tokens
hold.  The mask covers the texts of new assistant turns; repeated turns are never under it.  A turn is
never cut, so one longer than the budget stands in a window of its own.

Turns stream through in order, so memory holds a window at a time, even of a conversation without end; a
conversation's digest is a sequence too, so each conversation is one task's stream.  Windows carry their number, so
they can be written, dealt anew and read back in any order.

Cases: null texts and roles are empty; rows of a null conv_id are one conversation; rows that share conv_id
and turn stand in order of role and text, null turns first; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uploadwatch.llm.codec import codec, tokenizer_path
from uploadwatch.llm.common import bounded_batches
from uploadwatch.llm.tokens import TOKENIZER

BUDGET, HISTORY = 1024, 256
#: Control strings of common chat templates, this one's among them.
CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_PARTS = re.compile(r"<\|(turn|again)\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>\n", re.S)
_BATCH = 256
WINDOWS = "conv_id bigint, window int, text string, mask array<struct<start:int,past:int>>, n_tokens bigint"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted_turn(role: str, text: str, again: bool = False) -> str:
    return f"<|{'again' if again else 'turn'}|>" + escape(role).replace("\n", "\\\n") + "\n" + escape(text) + "<|end|>\n"


class _Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history, self.number = conv_id, budget, history, 0
        self.system: tuple[str, str, int] | None = None
        self.again: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []

    def cost(self) -> int:
        kept = self.system[2] if self.system and self.number else 0
        return kept + sum(t[2] for t in self.again) + sum(t[2] for t in self.new)

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """The window that this turn completes, if any."""
        done = None
        if self.new and self.cost() + tokens > self.budget:
            done = self.take()
            seen = [t for t in [*self.again, *self.new] if t is not self.system]
            room = min(self.history, self.budget - tokens - (self.system[2] if self.system else 0))
            sums = list(accumulate((t[2] for t in seen), initial=0))
            self.again = seen[bisect_left(sums, sums[-1] - room) :]  # the earliest turn from which all that follow fit
            self.new = []
            self.number += 1
        turn = (role, text, tokens)
        if self.number == 0 and not self.new and role == "system":
            self.system = turn
        self.new.append(turn)
        return done

    def take(self) -> tuple:
        parts, mask, at = [], [], 0
        kept = [self.system] if self.system and self.number else []
        for again, turns in ((True, [*kept, *self.again]), (False, self.new)):
            for role, text, _ in turns:
                parts.append(formatted_turn(role, text, again))
                if not again and role == "assistant":
                    past = at + len(parts[-1]) - len("<|end|>\n")
                    mask.append({"start": past - len(escape(text)), "past": past})
                at += len(parts[-1])
        return (self.conv_id, self.number, "".join(parts), mask, self.cost())


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, window, text, mask (intervals of code points under the loss), n_tokens; a conversation's windows follow each other."""
    path = tokenizer_path(tokenizer)
    columns = ["conv_id", "turn", "role", "text"]
    turns = bounded_batches(conversations).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns[2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, current, out = codec(path), None, []
        for batch in batches:
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            tokens = [len(x) // source.dtype.itemsize for x in source.encode([formatted_turn(r, t) for r, t in zip(roles, texts)])]
            for conv_id, role, text, n in zip(ids, roles, texts, tokens):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        out.append(current.take())
                    current = _Windows(conv_id, budget, history)
                done = current.add(role, text, n)
                if done:
                    out.append(done)
                if len(out) >= _BATCH:
                    yield _window_rows(out)
                    out = []
        if current is not None:
            yield _window_rows([*out, current.take()])

    return turns.repartition("conv_id").sortWithinPartitions(*columns).mapInArrow(run, WINDOWS)


def _window_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("past", pa.int32())])), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "window", "text", "mask", "n_tokens"])


def parse(text: str) -> list[tuple[str, str, bool]]:
    """role, text and whether it is new, of a window's turns."""
    return [(unescape(m[2]), unescape(m[3]), m[1] == "turn") for m in _PARTS.finditer(text)]


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def write_windows(formatted: DataFrame, path: str) -> None:
    formatted.write.option("compression", "zstd").parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WINDOWS).parquet(path)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of windows, from their numbers, texts and masks alone, in whatever order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            for conv_id, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "mask"))):
                if state is None or conv_id != state[0]:
                    if state is not None:
                        out.append(_digest(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, new in parse(text):
                    if new:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    loss = unescape(text[span["start"] : span["past"]])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
                state[6] += 1
            if out:
                yield _digest_rows(out)
                out = []
        if state is not None:
            yield _digest_rows([_digest(state)])

    dealt = bounded_batches(formatted).select("conv_id", "window", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, DIGEST)


def _digest(state: list) -> list:
    return [x.hexdigest() if hasattr(x, "hexdigest") else x for x in state]


def _digest_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in DIGEST.split(", ")])
