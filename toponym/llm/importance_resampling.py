"""Importance resampling: documents whose word runs look like those of a target corpus are drawn, with a fixed pseudo-random part.

Runs of words fall into hashed buckets. A bucket's gain is the logarithm of how much more often the target has it; a document's weight is the mean gain of its runs.
Gumbel noise from a document's id is added, so that the highest scores are a sample without replacement in proportion to the weights.

Everything is DataFrame code. Texts are exploded twice: once for the counts of all buckets, which task-side sums reduce to a row for each bucket, and once for the sums of
documents, where all runs of a text are in one task and its row is all that is shuffled. The table of gains has `buckets` rows and is broadcast. Ranks come from a range-partitioned sort: rows of
earlier partitions plus the place within the partition.

Cases: a null text has no words; a text without words has weight 0 and is never drawn; texts of any length are exploded in parts of about PART characters, cut between words, so that
no array is larger. Rows that repeat id and text are documents of their own with equal scores; rows that share an id only are documents of their own too, ties going to the
smaller id and then to the smaller hash of the text. A null id counts as empty text for the noise and comes first among ties. An empty table gives no rows; an empty target is one without features. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Characters of a word.
WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
#: Characters of a text that are exploded at once; a longer word stays whole.
PART = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Sampling:
    """Runs of 1 to `longest` words, number of buckets, documents drawn in 100, least words of a document to be drawn, and the seed of the noise."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def _lowered(text: Column) -> Column:
    """A-Z as a-z. ASCII, where both are the same, is taken the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _exploded(rows: DataFrame, sampling: Sampling) -> DataFrame:
    """rows (text and others) as (others, first, bucket): a row for each run of words, with a null bucket where a break left an empty piece; a text without words keeps a row. `first` marks one row of each text."""
    keys = [c for c in rows.columns if c != "text"]
    pattern = rf"(?s)(.{{1,{PART}}}[{WORD}]*+)(?=((?:[^{WORD}]*+[{WORD}]++){{0,{sampling.longest - 1}}}))"
    parts = lambda group: F.when(F.length("text") <= PART, F.array(F.col("text") if group == 1 else F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
    pieces = lambda c: F.split(c, f"[^{WORD}]+")
    if sampling.longest == 1:
        runs = rows.select(*keys, F.posexplode_outer(parts(1)).alias("at", "part")).select(*keys, "at", F.posexplode_outer(pieces(F.col("part"))).alias("place", "run"))
    else:
        both = rows.select(*keys, F.posexplode_outer(F.arrays_zip(parts(1).alias("own"), parts(2).alias("next"))).alias("at", "part"))
        words = lambda c: F.filter(pieces(F.coalesce(c, F.lit(""))), lambda w: w != "")
        listed = both.select(*keys, "at", words(F.col("part.own")).alias("own"), words(F.col("part.next")).alias("next"))
        here, rest = F.size("own"), F.concat("own", "next")
        from_place = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(sampling.longest), F.size(rest) - i)), lambda k: F.array_join(F.slice(rest, i + 1, k), " "))
        found = F.when(here > 0, F.flatten(F.transform(F.sequence(F.lit(0), here - 1), from_place)))
        runs = listed.select(*keys, "at", F.posexplode_outer(found).alias("place", "run"))
    first = (F.coalesce("at", F.lit(0)) == 0) & (F.coalesce("place", F.lit(0)) == 0)
    bucket = F.when(F.col("run") != "", F.pmod(F.crc32(_lowered(F.col("run")).cast("binary")), F.lit(sampling.buckets)).cast("int"))
    return runs.select(*keys, first.alias("first"), bucket.alias("bucket"))


def gain_table(docs: DataFrame, target: DataFrame, sampling: Sampling) -> DataFrame:
    """(bucket, gain) of the buckets that occur in docs or target, at most sampling.buckets rows."""
    held = lambda rows, own, other: _exploded(rows.select("text"), sampling).where("bucket is not null").select("bucket", F.lit(own).cast("long").alias("s"), F.lit(other).cast("long").alias("t"))
    counts = held(docs, 1, 0).unionByName(held(target, 0, 1)).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = Window.partitionBy()  # of at most `buckets` rows
    d = lambda c: c.cast("double")
    over, under = d(F.col("t") + 1) * d(F.sum("s").over(every) + sampling.buckets), d(F.col("s") + 1) * d(F.sum("t").over(every) + sampling.buckets)
    return counts.select("bucket", F.floor(1000 * F.log(over / under)).alias("gain"))


def scores(docs: DataFrame, gains: DataFrame, sampling: Sampling) -> DataFrame:
    """(doc_id, text_hash, n_features, weight, score) of every row of docs."""
    keys = ["doc_id", "text_hash", "text_bytes"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("text_bytes"), "text")
    # at most `buckets` rows
    runs = _exploded(rows, sampling).join(F.broadcast(gains), "bucket", "left")
    # rows that repeat id and text are summed together, and are as many as texts began
    sums = runs.groupBy(*keys).agg(F.count_if("first").alias("copies"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.when(F.col("n") > 0, F.expr("(total - pmod(total, n)) div n")).otherwise(F.lit(0)).cast("long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{sampling.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    one = sums.select("doc_id", "text_hash", (F.col("n") / F.col("copies")).cast("long").alias("n_features"), weight.alias("weight"), (weight + noise).alias("score"), "copies")
    once, more = one.where("copies = 1").drop("copies"), one.where("copies > 1")
    return once.unionByName(more.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "col"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `rank` 1, 2, 3, ... in order and their number `rank_of`: a range-partitioned sort, whose partitions' sizes give the offsets. Ranks do not depend on the number of partitions where the order has no ties."""
    apart = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id is the partition's number and, in its lower 33 bits, the row's place
    placed = written(apart.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # of a row for each partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("rank_of"))
    place = F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + place + 1).drop("__id", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text): rank is null where a document is not drawn."""
    gains = gain_table(docs, target, sampling)
    every = written(scores(docs, gains, sampling))
    least = sum(max(sampling.least_words - k, 0) for k in range(sampling.longest))  # features of a text with so many words
    long = ranked(every.where(F.col("n_features") >= least), [F.desc("score"), F.asc("doc_id"), F.asc("text_hash")])
    drawn = F.when(F.col("rank") * 100 <= F.col("rank_of") * sampling.percent, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = every.where(F.col("n_features") < least).select(*columns, F.lit(None).cast("long").alias("rank"))
    return long.select(*columns, drawn.alias("rank")).unionByName(rest)
