"""Token counts by a whole-token shortcut.

A sentencepiece BPE model with byte fallback, no normalisation and blanks written as U+2581 merges within a
pre-token only, if no piece has U+2581 after another character: then no merge joins what stands before a blank
with the blank. `WholeTokens` reads the vocabulary once, checks that condition, and proves by encoding each piece alone which
strings become exactly one token. Those are counted by a look-up; only other pre-tokens are merged.

Null text counts as empty (0 bytes, 0 tokens). Ties and repeated rows: each row is counted by itself. Other columns
of the input are not read, so clashing names cannot matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, slices

BLANK = "▁"
#: A pre-token: a run of blanks with what follows up to the next blank.
PRE_TOKEN = re.compile(f"{BLANK}+[^{BLANK}]*")
#: Merged pre-tokens that a worker remembers; when there are more it starts afresh. Only speed depends on it.
REMEMBERED = 1_000_000


class WholeTokens:
    """Counts of pre-tokens by one vocabulary."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece has a blank inside, so pre-tokens do not encode separately")
        if self.model.encode("a  bｃ", out_type=str)[:3] != [BLANK + "a", BLANK, BLANK + "b"] or self.model.encode("  a", out_type=str) == [BLANK + "a"]:
            raise ValueError("the model removes blanks, so pre-tokens do not encode separately")
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        starts = [p for p in plain if p[0] == BLANK]
        # the model puts one blank before a text, which stands for the first blank of the piece
        bare = [p[1:] for p in starts]
        self.single = dict.fromkeys((p for p, ids in zip(bare, self.lengths(bare), strict=True) if ids == 1), 1)
        self.known = dict(self.single)

    def lengths(self, bare: list[str]) -> list[int]:
        """Tokens of pre-tokens given without their first blank."""
        return [len(x) if t else 1 for t, x in zip(bare, self.model.encode([t.replace(BLANK, " ") for t in bare], num_threads=1), strict=True)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or BLANK in text:
            parts = [t[1:] for t in PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK))]
        else:
            parts = text.split(" ")
        known = self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            rest = list({t for t in parts if t not in known})
        if len(known) > REMEMBERED:
            self.known = known = dict(self.single)
            rest = list({t for t in parts if t not in known})
        known.update(zip(rest, self.lengths(rest), strict=True))
        return sum(map(known.__getitem__, parts))


def token_counts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: key, n_bytes (UTF-8), n_tokens, over_limit. No shuffle; model_file must be on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WholeTokens(model_file)
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([tokens.count(t) for t in texts], pa.int64())], names=["key", "n_bytes", "n_tokens"])

    c: Column = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), c.alias("text"), F.octet_length(c).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(released(count), f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
