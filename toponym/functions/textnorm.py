"""Normal forms of names and house numbers, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose upper-case form is several letters in Java but which stay one letter here; they become blanks. (Fixed values.)
SEVERAL = "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"
#: Latin letters that look like Cyrillic ones, and those. (Fixed values.)
LATIN = "ABCEHKMOPTXY"
CYRILLIC = "АВСЕНКМОРТХУ"


def norm_text(c: Column) -> Column:
    """Upper case; every run of characters other than digits, A-Z, А-Я and hyphen becomes one blank; no blanks at the ends. Null: empty.

    Only a capital Ё becomes Е: a small ё turns into Ё later, which is none of the letters kept.
    """
    upper = F.upper(F.translate(F.coalesce(c, F.lit("")), f"Ё{SEVERAL}", "Е" + " " * len(SEVERAL)))
    return F.trim(F.regexp_replace(upper, "[^0-9A-ZА-Я-]+", " "))


def ocr_norm_text(c: Column) -> Column:
    """norm_text with Latin look-alikes as Cyrillic letters."""
    return F.translate(norm_text(c), LATIN, CYRILLIC)


def norm_house(c: Column) -> Column:
    """Digits and letters of ocr_norm_text only."""
    return F.regexp_replace(ocr_norm_text(c), "[^0-9А-ЯA-Z]+", "")


def house_leading_number(c: Column) -> Column:
    """The leading digits of norm_house as a long; null if there are none. More digits than a long has raise an error."""
    return F.nullif(F.regexp_extract(norm_house(c), "^[0-9]+", 0), F.lit("")).cast("long")


def house_match_score(house: Column, first: Column, last: Column) -> Column:
    """float: null without a house; 1 at either end of a range; 0.95 within it by leading numbers, in either direction; else 0."""
    q, a, b = norm_house(house), norm_house(first), norm_house(last)
    n, lo, hi = house_leading_number(house), house_leading_number(first), house_leading_number(last)
    within = n.isNotNull() & lo.isNotNull() & hi.isNotNull() & n.between(F.least(lo, hi), F.greatest(lo, hi))
    return F.when(q == "", None).when((q == a) | (q == b), 1.0).when(within, 0.95).otherwise(0.0).cast("float")


def house_match(score: Column) -> Column:
    """Whether the score reaches 0.95. A float 0.95 is below the double 0.95, so only ends of a range match."""
    return score.cast("double") >= F.lit(0.95)


def norm_text_value(value: str | None) -> str:
    """norm_text of a single value."""
    table = str.maketrans({"Ё": "Е"} | dict.fromkeys(SEVERAL, " "))
    return re.sub("[^0-9A-ZА-Я-]+", " ", (value or "").translate(table).upper()).strip(" ")


def ocr_norm_text_value(value: str | None) -> str:
    return norm_text_value(value).translate(str.maketrans(LATIN, CYRILLIC))
