"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns: a running prefix sum of turn
tokens closes a window where the next turn would pass ``budget``.  Every window
starts with the system turn (if the first turn is one) and with the longest run of
preceding turns within ``history`` tokens that leaves room for the next turn; those turns are marked ``ctx`` and
masked, so each assistant text is a target exactly once.  A turn beyond the budget
gets a window of its own (with the system turn) and is never cut.

Template: ``<turn ROLE>\\nTEXT</turn>\\n`` (``<turn ROLE ctx>`` for repeated turns).  In
texts a backslash goes before each backslash and before ``<turn`` and ``</turn``;
in roles before backslash, blank, newline, ``<`` and ``>``.  :func:`parse` undoes both.

Edge cases: null role or text is empty; rows are taken by (turn, role, text), nulls
first, and repeated rows count as turns of their own; rows with a null conv_id are
one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGET, HISTORY = 256, 64
WINDOWS = "conv_id long, window long, text string, targets array<struct<start:long,end:long>>"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(r"<turn ((?:[^\\ >]|\\.)*)( ctx)?>\n([^\\<]*(?:(?:\\.|<(?!/?turn))[^\\<]*)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"\\|<(?=/?turn)", r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\ \n<>]", r"\\\g<0>", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(text: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """(role, text, repeated, start, end) of each turn; start and end bound the escaped text."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        yield unescape(m[1]), unescape(m[3]), m[2] is not None, m.start(3), m.end(3)
        at = m.end()


class _Packer:
    """One conversation at a time; holds the open window, the system turn and the history only."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history

    def begin(self, conv):
        self.conv, self.n, self.prefix, self.base = conv, 0, 0, 0
        self.system, self.context, self.fresh, self.past = None, [], [], []

    def add(self, role: str, text: str):
        tokens = len(_TOKEN.findall(text)) + 1
        if self.fresh and self.prefix - self.base + tokens > self.budget:
            yield self.flush()
            self.open(tokens)
        if self.n == 0 and not self.fresh and role == "system":
            self.system = (role, text, tokens)
        self.fresh.append((role, text))
        self.prefix += tokens
        self.past.append((role, text, self.prefix, tokens))
        while len(self.past) > 1 and self.past[-1][2] - self.past[0][2] + self.past[0][3] > self.history:
            self.past.pop(0)

    def open(self, tokens: int):
        """A new window for a turn of ``tokens``: the system turn, and what history fits beside both."""
        own = self.system[2] if self.system else 0
        room = min(self.history, self.budget - own - tokens)
        past = self.past[1:] if self.system and self.past and self.past[0][2] == own else self.past  # the system turn is there already
        past = [x for x in past if self.prefix - x[2] + x[3] <= room]
        self.context = ([self.system[:2]] if self.system else []) + [x[:2] for x in past]
        self.base = self.prefix - sum(x[3] for x in past) - own
        self.fresh = []

    def flush(self) -> dict:
        parts, spans, at = [], [], 0
        for turns, mark in ((self.context, " ctx"), (self.fresh, "")):
            for role, text in turns:
                head, body = f"<turn {escape_role(role)}{mark}>\n", escape(text)
                if role == "assistant" and not mark:
                    spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts.append(f"{head}{body}</turn>\n")
                at += len(parts[-1])
        self.n += 1
        return {"conv_id": self.conv, "window": self.n - 1, "text": "".join(parts), "targets": spans}


_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("targets", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DIGESTS = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")])
DIGESTS = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _DIGESTS)


def _pack(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    """Windows of turns that come by conversation and in order."""
    packer, on, out, chars = _Packer(budget, history), False, [], 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if not on or conv != packer.conv:
                if on:
                    out.append(packer.flush())
                packer.begin(conv)
                on = True
            out.extend(packer.add(role or "", text or ""))
            chars += len(text or "")
            if len(out) > 2000 or (out and chars > 4_000_000):
                yield pa.RecordBatch.from_pylist(out, _WINDOWS)
                out, chars = [], 0
    if on:
        out.append(packer.flush())
    yield pa.RecordBatch.from_pylist(out, _WINDOWS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of windows that come by conversation and in order, read from their texts and spans alone."""
    state, rows = None, []
    for batch in batches:
        for conv, text, targets in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "targets")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    rows.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, body, repeated, _, _ in parse(text):
                if not repeated:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
            for span in targets:
                body = unescape(text[span["start"] : span["end"]])
                state[3] += len(body)
                state[4].update(body.encode())
            state[5] += len(text)
            state[6] += 1
        yield _digest_rows(rows)
        rows = []
    yield _digest_rows([state] if state is not None else [])


def _digest_rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, [x.hexdigest() if hasattr(x, "hexdigest") else x for x in r], strict=True)) for r in rows], _DIGESTS)


def _in_order(conversations: DataFrame) -> DataFrame:
    d = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations: conv_id, window (from 0), text, targets (code-point spans under the loss)."""
    return _in_order(conversations).mapInArrow(lambda batches: _pack(batches, budget, history), WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from stored windows alone: turns, loss text and sizes as digests."""
    d = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "text", "targets")
    return d.mapInArrow(_digest, DIGESTS)


def format_and_read_back(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """:func:`read_back` of :func:`format_conversations`, window by window in the same task: the texts are shuffled once."""
    return _in_order(conversations).mapInArrow(lambda batches: _digest(_pack(batches, budget, history)), DIGESTS)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return format_and_read_back(rows.unionByName(more))
