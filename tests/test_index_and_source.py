"""The trigram index, searches by tiers, the archive source and the bitmaps of references, against plain ways."""

import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from toponym.functions import sql
from toponym.functions.textnorm import norm_text, ocr_norm_text
from toponym.functions.trigram import THRESHOLD, similarity_to
from toponym.operators import candidates, validation
from toponym.operators.candidates import find_address_candidates
from toponym.plans.driver_tables import gazetteer
from toponym.plans.queries import SEARCHES
from toponym.sources import archive_source, name_index
from toponym.sources.snapshot import SPECS

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index(spark, tmp_path):
    r = random.Random(1)
    words = ["КИРОВА", "КИРОВСКАЯ", "ЛЕНИНА", "ЛЕНИНГРАДСКАЯ", "МИРА", "НОВАЯ", "НОВО", "1-Я", "УЛ", "A B", "ЭЭЭ"]
    rows = [(i * 40_000 - 70_000, " ".join(r.choices(words, k=r.randint(0, 4))) or None, r.choice([None, "", *words])) for i in range(300)]
    names = spark.createDataFrame(rows, "id long, name string, lex string")
    name, word = norm_text(F.col("name")), ocr_norm_text(F.col("lex"))
    path = str(tmp_path / "index")
    name_index.write(name_index.names_of({"s": (names, "id", name, word), "other": (names, "id", F.lit("МИРА"), word)}), path)
    index = name_index.NameIndex(spark, path)
    for value in ("КИРОВА", "НОВАЯ МИРА", "1-Я УЛ", "ЭЭЭ", "QQQ", "", "ЛЕНИН КИРОВ НОВ ЯЯЯ ЮЮЮ ХХХ"):
        near = names.select("id", similarity_to(name, value).alias("own"), similarity_to(word, value).alias("word")).where(F.col("own") >= F.lit(THRESHOLD))
        assert sorted(map(tuple, index.near("s", value).collect())) == sorted(map(tuple, near.select("id", F.greatest("own", "word")).collect())), value
    plan = executed(index.near("s", "НОВАЯ МИРА"))
    assert "PartitionFilters: [isnotnull(kind" in plan and "bucket" in plan.split("PartitionFilters")[1] and "In(gram" in plan
    most = spark.read.parquet(f"{path}/lists").select(F.size("places").alias("n"), F.col("places")[0] >= 0).agg(F.max("n")).first()[0]
    assert most <= name_index.BLOCK


@pytest.mark.parametrize("name", ["candidates_city_only", "candidates_street_house"])
def test_tiers_read_fewer_rows(spark, monkeypatch, name):
    g = gazetteer(spark, SF)
    g = candidates.Gazetteer(**{**g.__dict__, "address_range": g.address_range.cache()})
    monkeypatch.setattr(candidates, "TIER", 1)
    told = {}
    postal, city, street, house = SEARCHES[name]
    by_tiers = find_address_candidates(g, postal, city, street, house, 10, told).collect()
    monkeypatch.setattr(candidates, "TIER", 1 << 30)
    whole = {}
    assert by_tiers == find_address_candidates(g, postal, city, street, house, 10, whole).collect() and by_tiers
    assert whole["tiers"] == 1 and told["rows"] <= whole["rows"]
    if name == "candidates_city_only":
        assert told["rows"] < whole["rows"] / 2
    monkeypatch.setattr(candidates, "FEW_NAMES", 0)  # names as tables: one pass
    assert by_tiers == find_address_candidates(g, postal, city, street, house, 10).collect()


@pytest.mark.parametrize("stored", [True, False])
def test_archive_source(spark, tmp_path, stored):
    lines = ['7;"a ""b"" ; c";УЛ;;""', "", *(f"{i};УЛИЦА {'Я' * (i % 50)};;x{i};" for i in range(3000)), "8;ПОСЛЕДНЯЯ;;;"]
    path = str(tmp_path / "ADDRESS_20240102030405.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for s in SPECS:
            body = "\n".join([s.header, *(lines if s.table == "street" else [])])
            z.writestr(f"{s.prefix}_ALL_INS_20240102030405.txt", "﻿" + body)
    archive_source.register(spark)
    expected = [("7", 'a "b" ; c', "УЛ", None, ""), *((str(i), f"УЛИЦА {'Я' * (i % 50)}".strip() if i % 50 else "УЛИЦА ", None, f"x{i}", None) for i in range(3000)), ("8", "ПОСЛЕДНЯЯ", None, None, None)]
    for size in (1000, 4096, 1 << 20):
        rows = spark.read.format(archive_source.FORMAT).option("table", "street").option("rangeBytes", size).load(path)
        assert rows.rdd.getNumPartitions() == (1 if not stored or size > 200_000 else pytest.approx(rows.rdd.getNumPartitions())) and (not stored or size > 200_000 or rows.rdd.getNumPartitions() > 20)
        assert sorted(map(tuple, rows.collect())) == sorted(expected)
    assert spark.read.format(archive_source.FORMAT).option("table", "city").load(path).isEmpty()
    with pytest.raises(PySparkException, match="table has to be"):
        spark.read.format(archive_source.FORMAT).option("table", "x").load(path)
    wrong = str(tmp_path / "ADDRESS_x.zip")
    with zipfile.ZipFile(wrong, "w") as z:
        for s in SPECS:
            z.writestr(f"{s.prefix}_ALL_INS_20240102030405.txt", s.header if s.table != "city" else "IdCity")
    with pytest.raises(PySparkException, match="CT: header"):
        spark.read.format(archive_source.FORMAT).option("table", "street").load(wrong).count()


@pytest.mark.parametrize("maps", [1024, 2, 0])
def test_orphans(spark, monkeypatch, maps):
    monkeypatch.setattr(validation, "MAPS", maps)
    keys = spark.createDataFrame([(k,) for k in (0, 1, -1, -5, 32768, 32769, 70_000, None, 1)], "k int")
    codes = spark.createDataFrame([("000001",), ("123456",), (None,)], "k string")
    odd = spark.createDataFrame([("000001",), ("1",)], "k string")
    wide = spark.createDataFrame([(k * 10_000_000,) for k in range(-50, 50)], "k long")
    rows = spark.createDataFrame([(i, a, b, b, c) for i, (a, b, c) in enumerate([(0, "000001", 0), (1, "123456", 10_000_000), (-1, None, None), (2, "000001", 0), (None, "1", 0), (-5, "123457", 1), (32768, "x", 0), (32770, None, -500_000_000), (-2, "000001", 5)])], "id int, a int, b string, d string, c long")
    found = validation.orphans(rows, {"a": (keys, "k"), "b": (codes, "k"), "d": (odd, "k"), "c": (wide, "k")})
    held = [{0, 1, -1, -5, 32768, 32769, 70_000}, {"000001", "123456"}, {"000001", "1"}, {k * 10_000_000 for k in range(-50, 50)}]
    broken = [r["id"] for r in rows.collect() if any(r[c] is not None and r[c] not in h for c, h in zip("abdc", held, strict=True))]
    assert sorted(r["id"] for r in found.collect()) == broken and found.columns == rows.columns
    if maps == 1024:
        plan = executed(validation.orphans(rows, {"a": (keys, "k"), "b": (codes, "k")}))
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_trigrams_are_not_made_where_names_are_read(spark):
    """A table of names may come as one split: trigrams are made behind a shuffle, and once for equal names of a block (F5, F8)."""
    names = spark.createDataFrame([(i, f"МИРА {i % 3}", "НОВАЯ" if i % 2 else None) for i in range(200)], "id long, name string, lex string").coalesce(1)
    lists = name_index.postings(name_index.names_of({"s": (names, "id", F.col("name"), F.col("lex"))}))
    assert "array_distinct" not in executed(lists)
    held = {(r["kind"], r["gram"]): (list(r["places"]), set(r["sizes"])) for r in lists.collect()}
    assert held["s.name", " 1 "] == ([i for i in range(200) if i % 3 == 1], {7}) and held["s.word", "нов"] == (list(range(1, 200, 2)), {6})
    assert name_index.postings(name_index.names_of({"s": (names.limit(0), "id", F.col("name"), F.col("lex"))})).isEmpty()


def test_sql_search_judges_distinct_names(spark):
    """Similarities of the SQL search stay above the grouping of equal names (F9)."""
    g = gazetteer(spark, SF)
    for table in ("federal_subject", "district", "main_city", "city", "street", "address_range"):
        rows = getattr(g, table).withColumn("dataset_id", F.lit(1).cast("long"))
        name = {"main_city": "main_city_name", "city": "city_name", "street": "street_name"}.get(table)
        (rows.withColumn("name_norm", norm_text(F.col(name))) if name else rows).createOrReplaceTempView(f"current_{table}")
    try:
        sql.register(spark)
        found = spark.sql("SELECT * FROM find_address_candidates('000003', 'ЦУСТОМЕР#000000003', 'СМАЛЛ РИНГГ', '4')")
        plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        groupings = [n for n, line in enumerate(plan) if "Aggregate [name_norm" in line]
        assert len(groupings) == 3
        for n in groupings:
            below = next((m for m in range(n + 1, len(plan)) if depth(plan[m]) <= depth(plan[n])), len(plan))
            assert not any("array_distinct" in line for line in plan[n:below])
        assert found.count() == find_address_candidates(g, "000003", "ЦУСТОМЕР#000000003", "СМАЛЛ РИНГГ", "4").count() > 0
    finally:
        for view in ("federal_subject", "district", "main_city", "city", "street", "address_range"):
            spark.catalog.dropTempView(f"current_{view}")
