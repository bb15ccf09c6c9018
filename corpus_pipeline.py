"""A corpus pipeline over `documents`: language identification, near duplicates, benchmark decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written and read again as the next stage's docs. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponym.llm import byte_bpe, decontamination, language_id, ngram_jaccard, secret_scan
from toponym.llm.common import written
from toponym.llm.filters import anti_join, may_be_in

#: The least share of a language for a text to be taken as prose of that language.
LEAST_SHARE = 0.35
#: Near duplicates: five-word shingles, similarity 0.8 or more.
NEAR = ngram_jaccard.Likeness(5, 80)
#: Text of a chunk of byte_bpe. Smaller than its own: executors come with the memory that the stages before have taken; it shuffles more instead.
CHUNK_BYTES = 8 << 20


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with columns c0, c1, ..., which clash with none that an operator adds, and the name of the text's."""
    return docs.toDF(*(f"c{n}" for n in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in which no language has a share of LEAST_SHARE, go.

    Null, empty and letterless texts go; long texts are read whole; of languages with equal shares the first by name counts; repeated rows are judged each by itself. Labels come from
    `lang` of docs; where no row has one there is nothing to judge by, and all texts with a letter stay. An empty table stays empty; further columns are kept.
    """
    rows = language_id.sample(docs)
    if not rows:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    plain, text = _numbered(docs)
    found = language_id.predict(plain, language_id.fit(rows), text=text)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).drop("lang_pred", "score").toDF(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    It is decided by row: of rows that share an id, that with the smaller hash of its text comes first, and of rows that repeat id and text one stays. A null id comes before all others.
    Documents without words (null, empty, blank) stay, repeated or not. Whole texts are compared. An empty table stays empty; further columns are kept.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")).alias("key"), F.col("text").alias("text"))
    groups = written(ngram_jaccard.jaccard_components(keyed, NEAR, key="key").withColumnsRenamed({"component_id": "component"}))
    gone = groups.where("n_shingles > 0 and key <> component").select("key")
    repeated = groups.where("n_shingles > 0").groupBy("key").count().where("count > 1").select("key")
    left = anti_join(keyed.drop("text"), gone, "key")
    # rows that repeat id and text have equal keys; few keys are repeated
    may = may_be_in(left, repeated, "key", "may")
    once = may.where("may").join(repeated.withColumn("again", F.lit(True)), "key", "left")
    twice = once.where("again").dropDuplicates(["key"])
    return may.where("not may").select("doc.*").unionByName(once.where("again is null").select("doc.*")).unionByName(twice.select("doc.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null, empty and short texts stay; long texts are read whole; repeated rows are judged each by itself; ties of places do not matter. An empty table or benchmark changes nothing.
    Further columns are kept.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain, text = _numbered(docs)
    return decontamination.matches(plain, benchmark, text=text).where(F.size("matches") == 0).drop("matches").toDF(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars, where there is one, is that of the new text. No row goes.

    Null texts stay null; long texts are read whole; a secret that occurs several times is replaced each time; repeated rows change alike. Further columns are kept.
    """
    out = secret_scan.redacted(docs, secret_scan.train(secret_scan.labelled_findings(spark)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them.

    Null counts as empty, with no ids; long texts are encoded whole; repeated rows are encoded each by itself. Further columns are not read.
    """
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, whole=True, at_blanks=True, chunk_bytes=CHUNK_BYTES).drop("decoded")


STAGES = [
    ("language_id", by_language),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if n + 1 < len(STAGES) else docs
    return docs


#: Stages 1, 4 and 5 are not SQL: run() is tested against brute force.
ORACLE_SQL: dict[str, str] = {}
QUERIES = {"pipeline": run}
