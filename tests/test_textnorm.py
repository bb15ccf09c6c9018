import pytest
from pyspark.sql import functions as F

from toponym.functions import textnorm as t
from toponym.functions.trigram import similarity, similarity_to, trigrams, trigrams_of

CASES = [
    (None, "", ""), ("!!!", "", ""), ("Кирова", "КИРОВА", "КИРОВА"), ("Ёлка", "ЕЛКА", "ЕЛКА"), ("ёлка", "ЛКА", "ЛКА"),
    ("  ул. Кирова, д-4 ", "УЛ КИРОВА Д-4", "УЛ КИРОВА Д-4"), ("KИРОВА", "KИРОВА", "КИРОВА"), ("straße", "STRA E", "SТRА Е"), ("oﬃce", "O CE", "О СЕ"),
]


@pytest.mark.parametrize("text,norm,ocr", CASES)
def test_normal_forms(spark, text, norm, ocr):
    row = spark.createDataFrame([(text,)], "x string").select(t.norm_text(F.col("x")), t.ocr_norm_text(F.col("x"))).first()
    assert tuple(row) == (norm, ocr)
    assert (t.norm_text_value(text), t.ocr_norm_text_value(text)) == (norm, ocr)


@pytest.mark.parametrize("house,first,last,score,match", [
    ("4", "4", "4", 1.0, True), ("4", "2", "8", 0.95, False), ("4", "8", "2", 0.95, False), ("4a", "2", "8", 0.95, False), ("9", "2", "8", 0.0, False),
    (None, "2", "8", None, None), ("--", "2", "8", None, None), ("4", None, None, 0.0, False), ("д. 4", "Д4", None, 1.0, True),
])
def test_house(spark, house, first, last, score, match):
    score_ = t.house_match_score(F.col("h"), F.col("a"), F.col("b"))
    row = spark.createDataFrame([(house, first, last)], "h string, a string, b string").select(score_.alias("s"), t.house_match(score_)).first()
    assert (row[0] if row[0] is None else round(row[0], 6), row[1]) == (score, match)


@pytest.mark.parametrize("a,b,expected", [("word", "two words", 4 / 11), ("КИРОВА", "КНРОВА", 0.4), ("ПОДОЛЬСК ГОРОД", "ПОДОЛЬСК", 0.6), ("", "x", 0), ("--", "--", 0), (None, "x", 0), ("ab", "ab", 1)])
def test_similarity(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(similarity(trigrams(F.col("a")), trigrams(F.col("b"))), similarity_to(F.col("a"), b), similarity(trigrams(F.col("b")), trigrams(F.col("a")))).first()
    assert [round(x, 6) for x in row] == [round(expected, 6)] * 3
    assert set(trigrams_of(a)) == set(spark.createDataFrame([(a,)], "a string").select(trigrams(F.col("a"))).first()[0])
