"""Post-processing of recognised words: filter, lines, documents, and the best of several attempts.

Word rows: image_id, mode, idx, text, conf, left, top, width, height, block_num, par_num, line_num. Confidences are kept as whole ten-thousandths, so
that sums do not depend on their order; where a mean is rounded, it is rounded as the double that it is (`round4`).

`kept_words` and `lines` take word rows in any order, and shuffle them. Where each attempt's words lie together as an array, as a recognition engine gives them, `attempt_lines` and `attempt_documents`
give the same rows without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LINE = ["image_id", "mode", "block_num", "par_num", "line_num"]
#: Order of preprocessing modes when attempts are level. (Fixed values.)
MODES = ("gray", "otsu", "none", "adaptive")
#: Blanks at the ends of a word, and their pattern.
BLANKS = " \t\n\x0b\f\r"
BLANK_ENDS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def round4(x: Column) -> Column:
    """A double from 0 to 1, rounded to four decimals by its exact binary value, in ten-thousandths as long.

    A double that is nearest to a half is mostly a little above or below it, and that decides. The test is exact: x is split into two parts whose products with 20000
    have no rounding error.
    """
    down = F.floor(x * 10_000.0).cast("double")
    odd = down * 2 + 1  # 20000 times the half above
    carry = x * 134_217_729.0
    high = carry - (carry - x)
    past = (high * 20_000.0 - odd) + (x - high) * 20_000.0
    up = (past > 0) | ((past == 0) & (down % 2 == 1))
    return (down + F.when(up, 1.0).otherwise(0.0)).cast("long")


def kept_words(words: DataFrame) -> DataFrame:
    """Words with text and a confidence of zero or more, trimmed; adds conf_e4 (confidence in ten-thousandths, at most 10000) and weight (characters)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), BLANK_ENDS, "")
    conf = F.coalesce(F.col("conf").cast("string").try_cast("double"), F.lit(-1.0))
    rows = words.withColumns({"text": text, "__conf": conf}).where((F.col("text") != "") & (F.col("__conf") >= 0))
    e4 = round4(F.least(F.col("__conf") / 100.0, F.lit(1.0)))
    return rows.withColumns({"conf_e4": e4, "weight": F.greatest(F.length("text"), F.lit(1)).cast("long")}).drop("__conf")


def _kept(words: Column, conf_type: T.DataType) -> Column:
    """kept_words of an array of word structs, in the order of lines and of words within them."""
    whole = isinstance(conf_type, T.IntegralType)
    conf = lambda w: F.coalesce(w["conf"].cast("double") if whole else w["conf"].cast("string").try_cast("double"), F.lit(-1.0))
    # of a whole number the rounded hundredth is itself
    e4 = lambda w: F.least(w["conf"], F.lit(100)).cast("long") * 100 if whole else F.transform(F.array(F.least(conf(w) / 100.0, F.lit(1.0))), round4)[0]
    trimmed = lambda w: F.btrim(F.coalesce(w["text"], F.lit("")), F.lit(BLANKS))
    place = lambda w: (F.struct(*(w[c] for c in LINE[2:])).alias("line"), w["idx"])
    read = lambda w: F.struct(*place(w), trimmed(w).alias("text"), e4(w).alias("conf_e4"), w["left"], w["top"], (w["left"] + w["width"]).alias("right"), (w["top"] + w["height"]).alias("bottom"))
    return F.sort_array(F.filter(F.transform(F.filter(words, lambda w: conf(w) >= 0), read), lambda w: w["text"] != ""))


def _with_lines(attempts: DataFrame) -> DataFrame:
    """(image_id, mode, lines) of (image_id, mode, words): lines as an array of structs in order, each with the columns of `lines`."""
    conf_type = attempts.schema["words"].dataType.elementType["conf"].dataType
    rows = attempts.select("image_id", "mode", _kept(F.col("words"), conf_type).alias("__kept"))
    n, at = F.size("__kept"), lambda i: F.get("__kept", i - 1)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~at(i)["line"].eqNullSafe(at(i - 1)["line"]))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__starts", starts)
    weight, each = lambda w: F.greatest(F.length(w["text"]), F.lit(1)).cast("long"), lambda ws, c: F.transform(ws, lambda w: w[c])

    def line(ws: Column) -> Column:
        x, y = F.array_min(each(ws, "left")), F.array_min(each(ws, "top"))
        return F.struct(
            *(F.get(ws, 0)["line"][c].alias(c) for c in LINE[2:]), F.array_join(each(ws, "text"), " ").alias("text"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + w["conf_e4"] * weight(w)).alias("conf_sum"), F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + weight(w)).alias("weight"),
            x.alias("x"), y.alias("y"), (F.array_max(each(ws, "right")) - x).alias("width"), (F.array_max(each(ws, "bottom")) - y).alias("height"),
        )

    # by places: slice() copies the whole array each time
    part = lambda start, j: F.transform(F.sequence(start, F.coalesce(F.get("__starts", j + 1) - 1, n)), at)
    return rows.select("image_id", "mode", F.transform("__starts", lambda start, j: F.transform(F.array(part(start, j)), line)[0]).alias("lines"))


def attempt_lines(attempts: DataFrame) -> DataFrame:
    """`lines` of attempts (image_id, mode, words), whose words are arrays of structs with the other columns of word rows. Each row is an attempt by itself; null or empty words give no line."""
    # not inline: the filter that Spark infers for it repeats all of the lines' work
    return _with_lines(attempts).select("image_id", "mode", F.inline_outer("lines")).where("weight is not null")


def attempt_documents(attempts: DataFrame) -> DataFrame:
    """`documents` of attempts as in `attempt_lines`: a row for each attempt, also for one without words."""
    rows, total = _with_lines(attempts).withColumn("lines", F.coalesce("lines", F.array())), lambda c: F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x[c])
    out = rows.select("image_id", "mode", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), total("conf_sum").alias("conf_sum"), total("weight").alias("weight"))
    return out.select("image_id", "mode", "text", "n_lines", confidence().alias("conf_e4"))


def _joined(order: Column, text: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), by)


def lines(words: DataFrame) -> DataFrame:
    """One row per line of kept words: text in word order, the weighted confidence's sum and weight, and the union of the boxes."""
    return words.groupBy(*LINE).agg(
        _joined(F.col("idx"), "text", " ").alias("text"), F.sum(F.col("conf_e4") * F.col("weight")).alias("conf_sum"), F.sum("weight").alias("weight"),
        F.min("left").alias("x"), F.min("top").alias("y"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
    )


def confidence(total: str = "conf_sum", weight: str = "weight") -> Column:
    """The mean in ten-thousandths, rounded as the double between 0 and 1 that it is; 0 without words."""
    return F.coalesce(round4(F.try_divide(F.col(total).cast("double"), F.col(weight).cast("double") * 10_000.0)), F.lit(0))


def documents(line_rows: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """One row per image and mode: lines joined by line feeds in order, and the confidence. attempts: (image_id, mode) that must not be missing."""
    order = F.struct("block_num", "par_num", "line_num")
    out = line_rows.groupBy("image_id", "mode").agg(_joined(order, "text", "\n").alias("text"), F.sum("conf_sum").alias("conf_sum"), F.sum("weight").alias("weight"), F.count("*").alias("n_lines"))
    if attempts is not None:
        out = attempts.select("image_id", "mode").distinct().join(out, ["image_id", "mode"], "left")
    return out.select("image_id", "mode", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), confidence().alias("conf_e4"))


def best_attempt(docs: DataFrame, length: Column | None = None) -> DataFrame:
    """Of each image the attempt with the largest confidence, then the longest text, then the first mode. length: the text's, where rows have it and no text."""
    place = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    best = Window.partitionBy("image_id").orderBy(F.desc("conf_e4"), (F.length("text") if length is None else length).desc(), place, "mode")
    return docs.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def times(attempts: DataFrame) -> DataFrame:
    """(image_id, ocr_ms, attempts): the milliseconds of all attempts of an image, from rows with ocr_ms; null ones add nothing. Summed as decimals, so the order does not matter."""
    return attempts.groupBy("image_id").agg(F.round(F.coalesce(F.sum(F.col("ocr_ms").cast("decimal(18,6)")).cast("double"), F.lit(0.0)), 3).alias("ocr_ms"), F.count("*").alias("attempts"))


def attempts_as_rows(images: DataFrame, mode: str) -> DataFrame:
    """A row per image and preprocessing mode; `auto` means gray and otsu."""
    return images.withColumn("mode", F.explode(F.array(*map(F.lit, ("gray", "otsu") if mode == "auto" else (mode,)))))


def alternatives(docs: DataFrame) -> DataFrame:
    """(image_id, alternatives): every attempt with mode, confidence and text, in mode order."""
    place = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    return docs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "mode", "conf_e4", "text"))).alias("alternatives"))
