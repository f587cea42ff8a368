"""Operator 12: chat formatting in budgeted, turn-aligned windows.

A conversation becomes windows of whole turns.  Prefix sums of the turns'
tokens choose each window's span of new turns: the longest that fits into the
budget beside what is repeated, which is the system turn (the conversation's
first turn, if its role is system) and the last turns before the span, limited
in number and tokens.  Repeated turns are masked, so each assistant text is a
target once.  A turn that alone exceeds the budget is a window of its own,
marked ``over_budget``; nothing is cut or dropped.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles each
``<``, any backslashes, ``|`` gains one backslash, so no control string can
occur, and reading takes one away; a line break in a role is written ``<|n|>``.

Turns are numbered by a range sort, then dealt in slices of ``SLICE`` turns.  A
window never crosses a slice; each slice brings the system turn and the turns
before it along.  So a conversation with any share of all rows is work for many
tasks, windows do not depend on the partitioning, and a task holds one window.

Defined cases: null roles and texts are empty; turns come in order of (turn,
null first; role; digest of the text); rows without a conversation id are one
conversation; repeated rows are turns like others; an empty table gives no
windows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import portions, table
from planwise.llm.packing import WordTokenizer, public_tokenizer
from planwise.llm.turns import digest, grouped_rows, numbered, per_row, plain_turns

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|n|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 2048, 4, 512
SLICE = 4096
MARKS = 2  # tokens for the start and end mark of a turn
COUNT_CHARS = 1 << 20
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def lead(role: str) -> str:
    return f"{START}{escape(role).replace(chr(10), BREAK)}\n"


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index(f"{END}\n", line)
        if not text.startswith(START, at):
            raise ValueError("a window does not begin with a turn")
        yield unescape(text[at + len(START):line].replace(BREAK, "\n")), unescape(text[line + 1:stop])
        at = stop + len(END) + 1


# ------------------------------------------------------------------ tokens
def with_tokens(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to batches of turns the tokens that each turn takes in a window."""
    def count(batches):
        encoder = None
        for b in portions(batches):
            encoder = encoder or WordTokenizer(tokenizer)  # a task without rows needs none
            names = b.schema.names
            sizes, held, chars = [], [], 0
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                held.append(f"{escape(role)}\n{escape(text)}")
                chars += len(text)
                if chars >= COUNT_CHARS:
                    sizes += [len(ids) // 4 + MARKS for ids in encoder.encode(held)]
                    held, chars = [], 0
            sizes += [len(ids) // 4 + MARKS for ids in encoder.encode(held)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], [*names, "tokens"])
    return count


# ------------------------------------------------------------------ windows
class Spans:
    """Windows of one slice of a conversation, turn by turn."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.most, self.most_tokens = budget, history_turns, history_tokens
        self.system: dict | None = None
        self.recent: list[dict] = []  # turns that may be repeated, then the new ones of the open window
        self.sums = [0]  # prefix sums of their tokens
        self.fresh = 0  # how many of them are old
        self.begin = 0  # where the open window's history begins
        self.lead = 0  # tokens of the repeated system turn

    def see(self, turn: dict) -> None:
        """A turn of the slice before."""
        self._push(turn)
        self.fresh = len(self.recent)

    def _push(self, turn: dict) -> None:
        self.recent.append(turn)
        self.sums.append(self.sums[-1] + turn["tokens"])

    def _open(self, turn: dict) -> None:
        """Choose what the window of this first new turn repeats."""
        self.lead = self.system["tokens"] if self.system else 0
        n = self.fresh
        room = min(self.most_tokens, self.budget - self.lead - turn["tokens"])
        first = bisect_left(self.sums, self.sums[n] - max(room, 0))
        self.begin = max(first, n - self.most)

    def add(self, turn: dict) -> tuple | None:
        """The window that the turn closes, if any."""
        out = None
        n = len(self.recent)
        if n > self.fresh and self.lead + self.sums[n] - self.sums[self.begin] + turn["tokens"] > self.budget:
            out = self.close()
        if len(self.recent) == self.fresh:
            self._open(turn)
        self._push(turn)
        return out

    def close(self) -> tuple | None:
        """The open window: (first turn, turns, repeated turns, tokens, over budget, text, loss starts, loss lengths)."""
        fresh = self.recent[self.fresh:]
        if not fresh:
            return None
        old = ([self.system] if self.system else []) + self.recent[self.begin:self.fresh]
        parts, at, starts, lengths = [], 0, [], []
        for k, t in enumerate(old + fresh):
            head, body = lead(t["role"]), escape(t["text"])
            if k >= len(old) and t["role"] == "assistant" and body:
                starts.append(at + len(head))
                lengths.append(len(body))
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        tokens = self.lead + self.sums[-1] - self.sums[self.begin]
        out = (fresh[0]["pos"], len(old) + len(fresh), len(old), tokens, tokens > self.budget, "".join(parts), starts, lengths)
        if fresh[0]["pos"] == 0 and fresh[0]["role"] == "system":
            self.system, fresh = fresh[0], fresh[1:]
        keep = (self.recent[:self.fresh] + fresh)[-self.most:] if self.most else []
        self.recent, self.sums = [], [0]
        for t in keep:
            self._push(t)
        self.fresh = len(keep)
        return out


WINDOW = ("slice bigint, window bigint, first_turn bigint, n_turns bigint, n_repeated bigint, n_tokens bigint, "
          "over_budget boolean, text string, loss_starts array<bigint>, loss_lengths array<bigint>")


def chat_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
                 history_tokens: int = HISTORY_TOKENS, slice_turns: int = SLICE) -> DataFrame:
    """Windows of plain turns (conv_id, turn, role, text): conv_id and the columns of WINDOW.

    ``n_repeated`` turns at a window's start have been seen before; the loss mask is the spans of code points
    ``loss_starts``, ``loss_lengths`` of ``text``.
    """
    if history_turns >= slice_turns:
        raise ValueError("a slice must hold more turns than are repeated")
    id_type = turns.schema["conv_id"].dataType.simpleString()
    rows = numbered(turns.select("conv_id", "turn", "role", "text", digest().alias("digest")), "conv_id", ["turn", "role", "digest"],
                    "chat-turns", with_tokens(tokenizer), "tokens bigint")
    rows = rows.select("conv_id", (F.col("pos") / slice_turns).cast("bigint").alias("slice"), F.lit(2).alias("kind"), "pos",
                       "role", "text", "tokens")
    place = F.col("pos") % slice_turns
    last = rows.where(place == slice_turns - 1).groupBy("conv_id").agg(F.max("slice").alias("_last")).withColumnRenamed("conv_id", "_c")
    before = rows.where((place >= slice_turns - history_turns) & ~((F.col("pos") == 0) & (F.col("role") == "system")))
    before = before.withColumn("slice", F.col("slice") + 1).withColumn("kind", F.lit(1))
    system = (rows.where("pos = 0 AND role = 'system'").join(last, F.col("conv_id").eqNullSafe(F.col("_c")))
              .withColumn("slice", F.explode(F.expr("sequence(1L, _last + 1)"))).withColumn("kind", F.lit(0)).select(rows.columns))
    dealt = (rows.unionByName(before).unionByName(system).repartition("conv_id", "slice")
             .sortWithinPartitions("conv_id", "slice", "kind", "pos"))

    def cut(batches):
        unit, spans, k = None, None, 0
        for conv, _, row in grouped_rows(batches, "conv_id"):
            if spans is None or unit != (conv, row["slice"]):
                if spans and (window := spans.close()):
                    yield (*unit, k, *window)
                unit, spans, k = (conv, row["slice"]), Spans(budget, history_turns, history_tokens), 0
            if row["kind"] == 0:
                spans.system = row
            elif row["kind"] == 1:
                spans.see(row)
            elif window := spans.add(row):
                yield (*unit, k, *window)
                k += 1
        if spans and (window := spans.close()):
            yield (*unit, k, *window)
    return per_row(dealt, cut, f"conv_id {id_type}, {WINDOW}")


# ------------------------------------------------------------------ query
def _read_back(batches) -> Iterator[tuple]:
    """Sorted windows to (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    conv, sums = None, None

    def done():
        return conv, sums["n"], sums["turns"].hexdigest(), sums["chars"], sums["loss"].hexdigest(), sums["formatted"]
    for key, fresh, row in grouped_rows(batches, "conv_id"):
        if fresh:
            if sums:
                yield done()
            conv, sums = key, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
        text = row["text"]
        for k, (role, said) in enumerate(parse(text)):
            if k >= row["n_repeated"]:
                sums["n"] += 1
                sums["turns"].update(f"{role}\n{said}\n".encode())
        for start, length in zip(row["loss_starts"], row["loss_lengths"]):
            target = unescape(text[start:start + length])
            sums["chars"] += len(target)
            sums["loss"].update(target.encode())
        sums["formatted"] += len(text)
    if sums:
        yield done()


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, in order."""
    id_type = windows.schema["conv_id"].dataType.simpleString()
    rows = (windows.select("conv_id", "slice", "window", "n_repeated", "text", "loss_starts", "loss_lengths")
            .repartition("conv_id").sortWithinPartitions("conv_id", "slice", "window"))
    return per_row(rows, _read_back, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint")


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = plain_turns(table(spark, sf_dir, "conversations"))
    said = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_back(chat_windows(turns.unionByName(probe), public_tokenizer()))
