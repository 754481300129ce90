"""Conversations as training windows under a token budget, with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import chunk_encoder
from .common import ship, slices, tidy

BUDGET, HISTORY = 512, 128
#: Marks of this template, and control strings of common ones; none survives unescaped in a text.
OPEN, CLOSE, END = "<|", "|>\n", "</s>\n"
_CONTROL = re.compile(r"\\|<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
_ESCAPED = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {"\\": "\\", "l": "<", "b": "[", "p": "|", "n": "\n"}
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)

WINDOWS = "conv_id long, window int, text string, repeated int, n_turns int, loss array<struct<begin:int,end:int>>"
_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("repeated", pa.int32()), ("n_turns", pa.int32()), ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPED[m[0]], text)


def escape_role(role: str) -> str:
    return escape(role).replace("|", "\\p").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """Turns of a window: role, text, and where the escaped text stands in it."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


def estimated_tokens(formatted: str) -> int:
    """UTF-8 bytes / 4, for want of a tokenizer."""
    return -(-len(formatted.encode("utf-8", "surrogatepass")) // 4)


@dataclass
class _Turn:
    formatted: str
    head: int
    upto: int  # prefix sum of the conversation's tokens, with this turn
    tokens: int
    learns: bool


@dataclass
class _Conversation:
    conv_id: int | None
    budget: int
    history: int
    learner: str
    system: _Turn | None = None
    old: list[_Turn] = field(default_factory=list)
    new: list[_Turn] = field(default_factory=list)
    total: int = 0
    windows: int = 0
    seen: int = 0

    def add(self, role: str, head: str, formatted: str, tokens: int) -> Iterator[dict]:
        self.total += tokens
        turn = _Turn(formatted, len(head), self.total, tokens, role == self.learner)
        before = self.new[0].upto - self.new[0].tokens if self.new else 0
        system = self.system.tokens if self.system else 0
        if self.new and system + sum(t.tokens for t in self.old) + self.total - before > self.budget:
            yield self.flush()
        if not self.new:
            system = self.system.tokens if self.system else 0
            while self.old and system + sum(t.tokens for t in self.old) + tokens > self.budget:
                self.old.pop(0)
        self.new.append(turn)
        self.seen += 1

    def flush(self) -> dict:
        again = ([self.system] if self.system else []) + self.old
        text, loss = "".join(t.formatted for t in again), []
        for t in self.new:
            if t.learns:
                loss.append({"begin": len(text) + t.head, "end": len(text) + len(t.formatted) - len(END)})
            text += t.formatted
        row = {"conv_id": self.conv_id, "window": self.windows, "text": text, "repeated": len(again), "n_turns": len(again) + len(self.new), "loss": loss}
        if not self.windows and self.new[0].formatted.startswith(OPEN + "system" + CLOSE):
            self.system = self.new[0]
        recent = self.old + self.new
        floor = self.total_at_end() - self.history
        self.old = [t for t in recent if t is not self.system and t.upto - t.tokens >= floor]
        self.new = []
        self.windows += 1
        return row

    def total_at_end(self) -> int:
        return self.new[-1].upto


def _counter(tokenizer: str | None) -> Callable[[list[str], list[str]], list[int]]:
    """Tokens of each turn, from its head and its escaped text: those of head, text and end, each by itself."""
    if tokenizer is None:
        return lambda heads, texts: [estimated_tokens(h + t + END) for h, t in zip(heads, texts, strict=True)]
    encoder, known = chunk_encoder(tokenizer, True), {}

    def count(heads: list[str], texts: list[str]) -> list[int]:
        if len(known) > 10_000:
            known.clear()
        if new := [h for h in {*heads, END} if h not in known]:
            known.update(zip(new, encoder.encode(new)[1].tolist(), strict=True))
        return [known[h] + n + known[END] for h, n in zip(heads, encoder.encode(texts)[1].tolist(), strict=True)]

    return count


def format_windows(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history: int = HISTORY, learner: str = "assistant") -> DataFrame:
    """Windows (see WINDOWS) of turns(conv_id, turn, role, text), in order within each conversation.

    Prefix sums of the turns' tokens, counted by the tokenizer file (estimated without one), end a window before the turn that would pass the budget; a
    turn that does not fit with the system turn alone stands whole in a window with it. A window after the first
    repeats the system turn that opened the conversation and as many last turns as the history holds and
    leave room for the first new turn; `repeated` counts them, and the loss covers only the learner's texts among the others, so each is learned once.

    A task holds one window at a time, however long a conversation is. Null text or role: empty. Null conv_id: one
    conversation. Ties in turn: by role, then text. Repeated rows are turns of their own. An empty table gives no windows. Other columns are ignored.
    A conversation's windows follow each other, so it is one task's work whatever its length."""
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[dict] = []
        count = _counter(tokenizer)
        for part in (p for batch in batches for p in slices(batch, 2)):
            roles, texts = [r or "" for r in part.column(1).to_pylist()], [escape(t or "") for t in part.column(2).to_pylist()]
            heads = [OPEN + escape_role(r) + CLOSE for r in roles]
            for conv, role, head, text, tokens in zip(part.column(0).to_pylist(), roles, heads, texts, count(heads, texts), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.flush())
                    now = _Conversation(conv, budget, history, learner)
                out += now.add(role, head, head + text + END, tokens)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, _WINDOWS)
                    out = []
        if now is not None:
            out.append(now.flush())
        if out:
            yield pa.RecordBatch.from_pylist(out, _WINDOWS)

    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(tidy(run), WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say (see DIGEST), from their texts and masks alone.

    The windows may come from files in any order: they are dealt by conversation and sorted again."""
    ship(windows.sparkSession)
    windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []

        def done() -> None:
            n, turns, chars, loss, formatted = state
            out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted})

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["window"] == 0:
                    if state is not None:
                        done()
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(row["text"])[row["repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    learned = unescape(row["text"][span["begin"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if state is not None:
            done()
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return windows.mapInArrow(tidy(run), DIGEST)


PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose texts are control strings."""
    probe = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
