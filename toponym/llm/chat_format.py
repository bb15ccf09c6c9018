"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. For each conversation the turn prefixes are rendered one after
another and each output is compared with the one before: what the outputs share stays, what follows is the new turn's piece. Where
a piece's text lies is found by rendering the turn with two probe texts: what both renderings share at the front and at the
back is the template's. An output that does not begin with the whole output before it shows a template that rewrites history.

Results have a row per turn: conv, turn, at (where the piece
starts in the output), piece, first and past (the text within the piece), loss (the text counts for training), rewrote.
Every prefix is rendered whole, however long, so rewriting is found at any distance; a task holds the turns of one conversation and the
outputs of its last turn, and the work of a conversation grows with the square of its turns. `digests` reads conversations back from such rows.

Turns are sorted by turn, then role and text (null first), so ties and repeated rows have one order. Null role or text counts as
empty. Null conversation ids are one conversation with a null id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Render = Callable[[list[tuple[str, str]]], str]
#: Turns of at most SHORT characters whose rendering `render_marked` remembers, as each is rendered again with every later prefix.
REMEMBERED = 32_768
SHORT = 1000
#: Strings that mark turns in this or another common template.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_MARK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    """text without any control string: backslashes doubled, and `\\-` put after the first character of each control string."""
    return _MARK.sub(r"\1\\-", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def _marked(role: str, text: str) -> str:
    return f"<|im_start|>{escape(role)}\n{escape(text)}<|im_end|>\n"


_remembered = lru_cache(REMEMBERED)(_marked)


def render_marked(turns: list[tuple[str, str]]) -> str:
    """The standard template: marks around each turn, its role on the first line, control strings escaped."""
    return "".join(_remembered(r, t) if len(r) + len(t) <= SHORT else _marked(r, t) for r, t in turns)


def read_marked(piece: str, first: int, past: int) -> tuple[str, str]:
    """Role and text of a piece that `render_marked` wrote."""
    return unescape(piece[len("<|im_start|>") : first - 1]), unescape(piece[first:past])


def _common(a: str, b: str) -> int:
    if a.startswith(b):
        return len(b)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # a and b are equal up to lo, and differ before or at hi
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def locate(render: Render, before: list[tuple[str, str]], turn: tuple[str, str], shown: str | None = None) -> tuple[str, int, str, int, int]:
    """The output with the turn; the length that it shares with the output without; the new piece; where the text lies in the piece."""
    shown = (render(before) if before else "") if shown is None else shown
    out = render([*before, turn])
    at = _common(out, shown)
    one, two = (render([*before, (turn[0], probe)]) for probe in ("0", "1"))
    front = _common(one, two)
    back = _common(one[front:][::-1], two[front:][::-1])
    return out, at, out[at:], max(front - at, 0), max(len(out) - back - at, 0)


def _turns(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in rows:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], many: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= many:
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def format_turns(turns: DataFrame, render: Render = render_marked, learn: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows described above, sorted by conversation and turn within each partition."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, order = turns.schema[conv].dataType, turns.schema[turn].dataType
    names = ["conv", "turn", "at", "piece", "first", "past", "loss", "rewrote"]
    kinds = [to_arrow_type(kind), to_arrow_type(order), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, before, shown = object(), [], ""
        for conv_id, number, speaker, said in _turns(batches):
            if conv_id != now:
                now, before, shown = conv_id, [], ""
            out, at, piece, first, past = locate(render, before, (speaker, said), shown)
            yield conv_id, number, at, piece, first, past, speaker == learn, at < len(shown)
            before.append((speaker, said))
            shown = out

    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = f"conv {kind.simpleString()}, turn {order.simpleString()}, at long, piece string, first int, past int, loss boolean, rewrote boolean"
    return dealt.mapInArrow(lambda b: _batches(pieces(b), names, kinds), schema)


def digests(formatted: DataFrame, read: Callable[[str, int, int], tuple[str, str]] = read_marked, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the rows of `format_turns` as they stand: sizes and digests of turns, loss text and output."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv"].dataType
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, any_, n, chars, size, rewrites, turns, loss = None, False, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for conv_id, at, piece, first, past, learn, rewrote in _turns(batches):
            if any_ and conv_id != now:
                yield now, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites
            if not any_ or conv_id != now:
                now, any_, n, chars, size, rewrites, turns, loss = conv_id, True, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text = read(piece, first, past)
            turns.update(f"{role}\n{text}\n".encode())
            n, size, rewrites = n + 1, at + len(piece), rewrites + rewrote
            if learn:
                chars += len(text)
                loss.update(text.encode())
        if any_:
            yield now, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites

    rows = formatted.select("conv", "at", "piece", "first", "past", "loss", "rewrote")
    schema = f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    out = rows.mapInArrow(lambda b: _batches(conversations(b), names, kinds), schema)
    return out.withColumnRenamed("conv", conv)
