"""Conversations as training texts in budgeted, turn-aligned windows.

A window is a text of at most `budget` tokens, as far as single turns allow: the conversation's system turn, then up to
`history` tokens of the turns just before, then new turns. Spans of new turns are chosen by prefix sums of turn
tokens: the next window begins at the first turn whose sum passes the last cut by more than the room that system turn and
history leave. Each turn is new in exactly one window. Loss lies on the texts of new assistant turns; the same texts
repeated as history are masked.

A turn is written as <|im_start|>role\\ntext<|im_end|>\\n. Where a text has "<|", with any number of backslashes between the two, one
backslash is put in, so no text can hold a control string, and taking one out gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_ranks, encoder

START, END = "<|im_start|>", "<|im_end|>\n"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

WINDOWS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("window", pa.int64()),
        ("text", pa.string()),
        ("n_repeated", pa.int32()),
        ("n_new", pa.int32()),
        ("tokens", pa.int64()),
        ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ]
)
_WINDOWS_DDL = "conv_id long, window long, text string, n_repeated int, n_new int, tokens long, loss array<struct<begin:long,end:long>>"
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_tokens(text: str) -> int:
    """A turn's cost by estimate, without a tokenizer: a token for each four bytes begun, and four for the template."""
    return -(-len(text.encode()) // 4) + 4


class _Conversation:
    """The windows of one conversation whose turns come one by one. It holds a window and a history, no more."""

    def __init__(self, conv_id, budget: int, history: int, cost_of: Callable[[str, str], int]):
        self.id, self.budget, self.history, self.cost_of = conv_id, budget, history, cost_of
        self.window, self.system, self.system_cost, self.first = 0, None, 0, True
        self.past: list[tuple[str, str, int]] = []  # candidates for the next window's history
        self.shown: list[tuple[str, str, int]] = []  # history of this window
        self.new: list[tuple[str, str, int]] = []
        self.sum = self.cut = 0  # prefix sums: of all turns, and where this window's new turns begin

    def add(self, role: str, text: str) -> dict | None:
        """Takes a turn; gives the window before it, if that is full."""
        cost = self.cost_of(role, text)
        room = self.budget - (self.system_cost if self.window else 0) - sum(c for *_, c in self.shown)
        done = self.close() if self.new and self.sum + cost - self.cut > room else None
        if self.first and role == "system":
            self.system, self.system_cost = (role, text, cost), cost
        elif not (self.first and role == "system"):
            self.past.append((role, text, cost))
        self.first = False
        self.new.append((role, text, cost))
        self.sum += cost
        return done

    def close(self) -> dict:
        repeated = ([self.system] if self.system and self.window else []) + self.shown
        pieces, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(repeated + self.new):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if i >= len(repeated) and role == "assistant":
                loss.append({"begin": at + len(head), "end": at + len(head) + len(body)})
            pieces += [head, body, END]
            at += len(head) + len(body) + len(END)
        row = {"conv_id": self.id, "window": self.window, "text": "".join(pieces), "n_repeated": len(repeated), "n_new": len(self.new), "tokens": sum(c for *_, c in repeated + self.new), "loss": loss}
        self.window += 1
        kept, cost = [], 0
        for x in reversed(self.past):
            if cost + x[2] > self.history:
                break
            kept.append(x)
            cost += x[2]
        self.past = self.shown = kept[::-1]
        self.past = list(self.past)
        self.new, self.cut = [], self.sum
        return row


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def windows(turns: DataFrame, budget: int = 512, history: int = 128, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """conv_id, window, text, n_repeated and n_new (turns), tokens, loss (begin and end in code points of text, in order).

    With a tokenizer file of byte-level BPE and its pattern, a turn costs the tokens of all that is written for it, with control strings as ordinary
    text; where the pattern splits between a line's end and "<", as GPT-2's does, they add up to those of a window's text. Without, turn_tokens() estimates.
    Turns are ordered by turn, role and text; nulls come first. A null text or role is empty, rows of a null conv_id are one conversation.
    A turn that alone passes the budget is a window's only new turn and is never cut. Repeated rows are turns of their own.
    An empty table gives no rows. Other columns are ignored. A conversation is sorted and read as a stream: what a
    task holds is one window, whatever the conversation's length.
    """
    if not 0 <= history < budget:
        raise ValueError("history must leave room in the budget")
    if (tokenizer is None) != (pattern is None):
        raise ValueError("a tokenizer needs its pattern")
    ranks = None if tokenizer is None else turns.sparkSession.sparkContext.broadcast(byte_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None if ranks is None else encoder(ranks.value, pattern).encode_to_numpy

        def cost_of(role: str, text: str) -> int:
            return turn_tokens(text) if encode is None else len(encode(f"{START}{escape_role(role)}\n{escape(text)}{END}", disallowed_special=()))

        now, out = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.id != conv:
                    if now:
                        out.append(now.close())
                    now = _Conversation(conv, budget, history, cost_of)
                done = now.add(role, text)
                if done:
                    out.append(done)
                if len(out) >= 2000:
                    yield _emit(out, WINDOWS)
                    out = []
        if now:
            out.append(now.close())
        if out:
            yield _emit(out, WINDOWS)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, _WINDOWS_DDL)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)]


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from windows(), one row for each conversation: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_windows. It takes windows() as it comes, with a conversation's
    windows one after another, and reads it as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close():
            conv, turns, n, loss, chars, total, count = now
            out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total, "n_windows": count})

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        close()
                    now = [r["conv_id"], hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(r["text"])[r["n_repeated"] :]:
                    now[1].update(f"{role}\n{text}\n".encode())
                    now[2] += 1
                for span in r["loss"]:
                    text = unescape(r["text"][span["begin"] : span["end"]])
                    now[3].update(text.encode())
                    now[4] += len(text)
                now[5] += len(r["text"])
                now[6] += 1
            if out:
                yield _emit(out, DIGESTS)
                out = []
        if now:
            close()
            yield _emit(out, DIGESTS)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
