"""Trigram similarity: words of letters and digits in lower case, each with two blanks before and one after."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names are alike from this similarity on.
THRESHOLD = 0.3


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text as array<string>; null: none."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigrams_of(value: str | None) -> list[str]:
    """The distinct trigrams of a single value, for literals."""
    out: dict[str, None] = {}
    for word in re.findall(r"[^\W_]+", (value or "").lower()):
        padded = f"  {word} "
        out.update(dict.fromkeys(padded[i : i + 3] for i in range(len(word) + 1)))
    return list(out)


def similarity(a: Column, b: Column) -> Column:
    """float: shared trigrams by all trigrams of two trigram arrays; 0 if there are none."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(0.0).cast("float")


def similarity_to(c: Column, value: str) -> Column:
    """similarity of a text column to one value, whose trigrams are computed once."""
    return similarity(trigrams(c), F.array(*map(F.lit, trigrams_of(value))).cast("array<string>"))
