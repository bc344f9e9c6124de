"""Chat formatting by incremental black-box rendering.

A template is any function from turns ``[(role, text), ...]`` to a string; nothing
else is known about it. The operator renders successive prefixes of a conversation and
compares consecutive outputs: what an output adds to the one before is the turn's
span, and an output that doesn't start with the one before shows a template that
rewrites history. The text inside a span is found by rendering the prefix twice
more with two different one-character probes in place of the last text.

Every prefix is rendered whole, for every template and however long a conversation is: nothing
that a template has shown so far tells what it does later. Of a conversation its turns and its
last output are held, and time grows with the square of its turns; a template can make that
cheap by remembering what it made of a turn, as :func:`turn_template` does.

Turns are put in order by a shuffle and a sort on (conversation, turn), and streamed:
no conversation is collected.

Edge cases: null texts and roles count as empty; null conversation ids form one
conversation; ties in turn are put in order of role, then text; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

Turns = list[tuple[str, str]]
#: Turns whose rendering is remembered, and characters up to which a turn is.
REMEMBERED, SHORT = 4096, 4000
PROBES = ("\x01", "\x02")

OPEN, CLOSE = "<|turn:", "<|end|>"
#: Control strings of common chat formats, escaped inside texts besides this template's own.
CONTROLS = [OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROLS))
_BARLESS = re.compile("|".join(re.escape(x) for x in CONTROLS if "|" not in x))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|turn:((?:\\.|[^\\|])*)\|>\n(.*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Double every backslash, and put one behind the first character of a control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As :func:`escape`, with a backslash before every bar, so that the first bare bar ends the role."""
    return _BARLESS.sub(lambda m: m[0][0] + "\\" + m[0][1:], role.replace("\\", "\\\\").replace("|", "\\|"))


def _turn(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}|>\n{escape(text)}{CLOSE}\n"


class _Remembered(dict):
    """Turns as rendered, up to ``REMEMBERED`` at a time."""

    def __missing__(self, turn: tuple[str, str]) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        self[turn] = out = _turn(*turn)
        return out


_KNOWN = _Remembered()


def turn_template(turns: Turns) -> str:
    return "".join([_KNOWN[turn] if len(turn[1]) <= SHORT else _turn(*turn) for turn in turns])


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of one turn of :func:`turn_template`."""
    m = _TURN.fullmatch(segment)
    if m is None:
        raise ValueError("not a turn of this template")
    return unescape(m[1]), unescape(m[2])


def common_prefix(a: str, b: str) -> int:
    """By halving: slices are compared, not characters."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Renderer:
    """Takes the turns of one conversation in order; gives, per turn, its segment and spans."""

    def __init__(self, render: Callable[[Turns], str]):
        self.render = render
        self.turns: Turns = []
        self.output = render([])

    def add(self, role: str, text: str) -> tuple[str, int, int, int, int, bool]:
        """Segment, start, end, start and end of its text, and whether earlier output changed.

        The output so far is ``output[:start] + segment``; offsets count code points.
        """
        was, now = self.output, self.render([*self.turns, (role, text)])
        rewrote = not now.startswith(was)
        start = common_prefix(was, now) if rewrote else len(was)
        a, b = self._text_span(role, now)
        self.turns.append((role, text))
        self.output = now
        return now[start:], start, len(now), a, b, rewrote

    def _text_span(self, role: str, now: str) -> tuple[int, int]:
        """Start and end, in ``now``, of the last turn's text."""
        one, two = (self.render([*self.turns, (role, p)]) for p in PROBES)
        head = common_prefix(one, two)
        tail = len(one) - head - 1
        return head, max(head, len(now) - tail)


SEGMENTS = "role string, turn_no long, segment string, start long, end long, text_start long, text_end long, loss boolean, rewrote boolean"


def _format(render: Callable[[Turns], str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, no = object(), None, 0
        for batch in batches:
            out = []
            for key, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or key != conv:
                    conv, state, no = key, Renderer(render), 0
                segment, start, end, a, b, rewrote = state.add(role, text)
                out.append((key, role, no, segment, start, end, a, b, role == "assistant", rewrote))
                no += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def format_conversations(conversations: DataFrame, render: Callable[[Turns], str] = turn_template) -> DataFrame:
    """One row per turn, in order within its partition: conv_id and the columns of ``SEGMENTS``."""
    rows = conversations.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv_id {kind}, {SEGMENTS}"
    return ordered.mapInArrow(_format(render, to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def _digest(schema: pa.Schema):
    """Read conversations back from their segments, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, turns, loss, loss_chars, total, rewrote = None, 0, None, None, 0, 0, False
        row = lambda: (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), total, rewrote)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if n and r["turn_no"] == 0:
                    done.append(row())
                    n = 0
                if n == 0:
                    conv, turns, loss, loss_chars, rewrote = r["conv_id"], hashlib.sha256(), hashlib.sha256(), 0, False
                role, text = parse_turn(r["segment"])
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if r["loss"]:
                    said = unescape(r["segment"][r["text_start"] - r["start"] : r["text_end"] - r["start"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    loss_chars += len(said)
                n, total, rewrote = n + 1, r["end"], rewrote or r["rewrote"]
            yield pack(done)
        if n:
            yield pack([row()])

    return run


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Per conversation, read back from the formatted output: counts and digests of turns and of what the loss covers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrote boolean"
    return format_conversations(rows.unionByName(extra)).mapInArrow(_digest(to_arrow_schema(StructType.fromDDL(ddl))), ddl)
