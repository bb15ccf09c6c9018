import json
import zipfile
from bisect import bisect_left, bisect_right
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from toponym.api import CandidateRequest, candidates, health
from toponym.cli import main
from toponym.functions import sql
from toponym.operators.candidates import COLUMNS, InvalidQuery, NoActiveDataset, clamp_limit, find_address_candidates
from toponym.sources import distribution
from toponym.sources.snapshot import SPECS, ContractError, archives, members, newest_archive, timestamp_column, timestamp_of
from toponym.sources.store import Store

ROWS = {
    "FS": ["1;МОСКОВСКАЯ ОБЛАСТЬ;;"], "DT": ["1;1;ПОДОЛЬСКИЙ;;"], "PC": ["142100;0;0;0;1;0;1"], "MC": ["1;1;1;ПОДОЛЬСК ГОРОД;ПОДОЛЬСК;", '2;1;;"";;'], "CT": ["1;1;КУТУЗОВО;;"],
    "SR": ["1;КИРОВА;УЛ;КИРОВА;", "", "2;ЛЕНИНА;УЛ;;"],
    "AR": ["1;142100;;1;1;1;;1;4;4;;;", "2;142100;;1;1;1;1;1;2;8;;;", "3;142100;;1;1;1;1;1;8;2;;;", "4;142100;;1;1;1;1;2;4;4;;;", "5;142100;Почта;1;1;;;1;;;;;"],
}
FEW = dict.fromkeys([s.table for s in SPECS], 1)


def archive(folder, name="ADDRESS_20240102030405.zip", rows=None, header=None, skip=(), twice=()):
    path = folder / name
    with zipfile.ZipFile(path, "w") as z:
        for s in SPECS:
            lines = [(header or {}).get(s.prefix, s.header), *({**ROWS, **(rows or {})})[s.prefix]]
            for n in range(2 if s.prefix in twice else 0 if s.prefix in skip else 1):
                z.writestr(f"dir{n}/{s.prefix.lower()}_ALL_INS_20240102030405.txt", "﻿" + "\r\n".join(lines) + "\r\n")
    return str(path)


@pytest.mark.parametrize("wrong", [{"skip": ("FS",)}, {"twice": ("SR",)}, {"header": {"AR": "IdAddress"}}, {"header": {"FS": "idsubject;SubjectName;lexKey1;lexKey2"}}])
def test_contract(tmp_path, wrong):
    with zipfile.ZipFile(archive(tmp_path)) as z:
        assert len(members(z)) == 7
    with zipfile.ZipFile(archive(tmp_path, "ADDRESS_x.zip", **wrong)) as z, pytest.raises(ContractError):
        members(z)


def test_names(tmp_path):
    with pytest.raises(FileNotFoundError):
        newest_archive(str(tmp_path))
    archive(tmp_path, "ADDRESS_20240101000000.zip")
    archive(tmp_path)
    assert newest_archive(str(tmp_path)).name == "ADDRESS_20240102030405.zip"
    assert timestamp_of("ADDRESS_20240102030405.zip").isoformat() == "2024-01-02T03:04:05+00:00" and timestamp_of("x") is None
    with pytest.raises(ValueError):
        timestamp_of("20241399000000")


def test_times_after_2099(spark):
    names = {
        "ADDRESS_20991231235959.zip": 4102444799, "ADDRESS_21000619140506.zip": 4117097106, "ADDRESS_97800430005826.zip": 246470173106, "ADDRESS_+155520109040506.zip": 428607173106, "ADDRESS_+120010101000000.zip": 316547827200,
        "120240102030405": 1704164645, "21000101000000_20240102030405": 1704164645, "1999010100000021": None, "99999999999999": None, "25000230000000": None, "121000619140506": None, "ADDRESS.zip": None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", timestamp_column(F.col("name")).cast("long").alias("t")).collect()
    assert {r["name"]: r["t"] for r in rows} == names
    for name, t in names.items():
        got = timestamp_of(name)
        assert (got and int(got.timestamp())) == (None if "+" in name else t)


def test_life_of_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "root"))
    assert health(store)["status"] == 503
    with pytest.raises(NoActiveDataset):
        store.current("street")
    path = archive(tmp_path)
    first = store.import_archive(path, activate=True, min_rows=FEW)
    assert store.active() == first and store.datasets()[0]["row_counts"]["address_range"] == 5
    city = {r["id_main_city"]: r for r in store.current("main_city").collect()}
    assert city[2]["main_city_name"] == "" and city[2]["id_district"] is None and city[1]["lex_key2"] is None and city[1]["name_norm"] == "ПОДОЛЬСК ГОРОД"
    with pytest.raises(ValueError, match="already"):
        store.import_archive(path, min_rows=FEW)
    broken = archive(tmp_path, "ADDRESS_20240203000000.zip", rows={"AR": ["1;999999;;7;1;1;;1;4;4;;;"]})
    with pytest.raises(ValueError, match="broken references"):
        store.import_archive(broken, min_rows=FEW)
    failed = store.datasets()[0]
    assert failed["status"] == "failed" and failed["validation"]["address_reference_orphans"] == 1 and store.active() == first
    with pytest.raises(ValueError):
        store.activate(failed["dataset_id"])
    with pytest.raises(ValueError, match="threshold"):
        store.import_archive(archive(tmp_path, "ADDRESS_20240204000000.zip", rows={"DT": ["1;1;ПОДОЛЬСКИЙ;x;"]}))
    second = store.import_archive(archive(tmp_path, "ADDRESS_20240205000000.zip", rows={"SR": ["1;КИРОВА;ПЕР;КИРОВА;", "2;Ленина;УЛ;;"]}), activate=True, min_rows=FEW)
    assert {d["dataset_id"]: d["status"] for d in store.datasets()}[first] == "retired"
    plan = store.current("street")._jdf.queryExecution().executedPlan().toString()
    assert "(dataset_id#" in plan and f"= {second})" in plan.split("PartitionFilters")[1]
    store.activate(first)
    assert store.prune(1) == [] and store.active() == first
    store.activate(second)
    assert store.prune(1) == [first] and store.active() == second and store.current("street").count() == 2


def test_views_functions_and_health(spark, tmp_path):
    for s in SPECS:
        spark.catalog.dropTempView(f"current_{s.table}")
    sql.register(spark)
    with pytest.raises(PySparkException, match=sql.NO_DATASET):
        spark.sql("SELECT * FROM find_address_candidates('12')").collect()
    store = Store(spark, str(tmp_path / "root"))
    (tmp_path / "in").mkdir()
    store.import_archive(archive(tmp_path / "in"), activate=True, min_rows=FEW)
    store.register_views()
    assert health(store)["active_dataset"]["dataset_id"] == 1 and health(store)["status"] == 200
    assert spark.sql("SELECT count(*) FROM current_address_range").first()[0] == 5 and spark.sql("SELECT status FROM active_dataset").first()[0] == "active"
    rows = spark.sql("SELECT * FROM find_address_candidates('142100', 'Подольск', 'Кирова', '4', 2)").collect()
    best = find_address_candidates(store.gazetteer(), "142100", "Подольск", "Кирова", "4", 2).collect()
    assert [(r["id_address"], r["score"], r["house_match"]) for r in rows] == [(r["id_address"], r["score"], r["house_match"]) for r in best] and len(rows) == 2
    assert [tuple(r) for r in rows] == [tuple(r) for r in best] and [c.split()[0] for c in sql.RESULT.split(", ")] == list(COLUMNS)
    assert spark.sql("SELECT * FROM find_address_candidates(street => 'Кирова', most => 1)").count() == 1
    for wrong, said in (("'---', '', '', ''", "6 digits"), ("'12', 'Подольск'", "6 digits"), ("'', '', '', '4'", "postal code, a city or a street"), ("NULL, '!!'", "postal code, a city or a street"), ("'999999'", None)):
        search = spark.sql(f"SELECT * FROM find_address_candidates({wrong})")
        if said is None:
            assert search.isEmpty()
        else:
            with pytest.raises(PySparkException, match=said):
                search.collect()
    told = {(r["table_name"], r["column_name"]): (r["n_rows"], r["nulls"], r["low"], r["high"]) for r in store.statistics(1).collect()}
    assert told["address_range", "id_city"] == (5, 2, "1", "1") and told["main_city", "main_city_name"] == (2, 0, "", "ПОДОЛЬСК ГОРОД")
    found = archives(spark, str(tmp_path / "in")).first()
    assert found["sha256"] == store.datasets()[0]["source_sha256"] and found["source_timestamp"].isoformat() == "2024-01-02T03:04:05"
    (tmp_path / "root" / "registry.json").write_text("{")
    assert health(store)["status"] == 503


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    root = ["--root", str(tmp_path / "root")]
    monkeypatch.setattr("toponym.operators.validation.MIN_ROWS", FEW)
    assert main([*root, "update", str(tmp_path)]) == 2
    path = archive(tmp_path)
    assert main([*root, "import", path]) == 0 and main([*root, "import", path]) == 2 and main([*root, "activate", "1"]) == 0 and main([*root, "activate", "9"]) == 2
    archive(tmp_path, "ADDRESS_20240302030405.zip", rows={"SR": ["1;КИРОВА;ПЕР;;", "2;ЛЕНИНА;УЛ;;"]})
    capsys.readouterr()
    assert main([*root, "update", str(tmp_path)]) == 0 and main([*root, "list"]) == 0
    assert [json.loads(x)["status"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["active", "retired"]
    assert main([*root, "prune", "--keep", "0"]) == 2 and main([*root, "prune", "--keep", "1"]) == 0 and Store(spark, str(tmp_path / "root")).active() == 2


def test_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "root"))
    store.import_archive(archive(tmp_path), activate=True, min_rows=FEW)
    g = store.gazetteer()
    for city, street, top in (("Подольск", "Кирова", 1.0), ("ПOДOЛЬСК", "KИРОВА", 1.0), ("Подольск", "КНРОВА", 0.82)):
        rows = find_address_candidates(g, "142100", city, street, "4").collect()
        assert rows[0]["id_address"] == 1 and round(rows[0]["score"], 4) == top and rows[0]["house_match"] is True and rows[0]["matched_city_name"] == "ПОДОЛЬСК ГОРОД"
        assert [(r["id_address"], round(r["house_score"], 2), r["house_match"]) for r in rows[1:]] == [(2, 0.95, False), (3, 0.95, False)]
    post = find_address_candidates(g, "142-100").collect()
    assert len(post) == 5 and post[4]["matched_city_name"] == "Почта" and post[0]["city_score"] is None and post[0]["house_match"] is None
    for wrong in ({"postal_code": "---"}, {"house": "4"}, {"city": "!!"}):
        with pytest.raises(InvalidQuery):
            find_address_candidates(g, **wrong)
    assert [clamp_limit(x) for x in (None, 0, 1000)] == [20, 1, 100]
    answer = candidates(g, CandidateRequest(postal_code="142100", street="Кирова", house="4"))
    assert answer["status"] == 200 and answer["count"] == 4 and candidates(g, CandidateRequest(city="!!"))["status"] == 503
    for wrong in ({}, {"postal_code": "12"}, {"city": " "}, {"city": "x" * 257}, {"street": "x", "limit": 0}):
        with pytest.raises(ValueError):
            CandidateRequest(**wrong)


def test_distribution(spark, tmp_path):
    """Skewed numbers and texts in two parts, merged by their sketches, against exact figures and the stated errors."""
    n = 40_000
    rows = spark.range(n, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 > 0, F.floor(F.sqrt("id"))).cast("int").alias("skewed"), F.when(F.col("id") % 2 == 0, "x").otherwise(F.concat(F.lit("v"), "id")).alias("many texts"),
        F.lit(None).cast("string").alias("nothing"), F.when(F.col("id") < 9, F.repeat(F.lit("y"), 2000)).otherwise("z").alias("wide"),
    )
    parts = rows.randomSplit([0.2, 0.8], seed=5)
    for i, p in enumerate(parts):
        distribution.write({"t": (p, rows.columns)}, str(tmp_path / f"s{i}"))
    found = {r["column_name"]: r for r in distribution.distribution(spark.read.parquet(*(str(tmp_path / f"s{i}") for i in (0, 1))), parts=20, common=5).collect()}
    for c in rows.columns:
        exact = [r[0] for r in rows.select(f"`{c}`").collect()]
        held = [x for x in exact if x is not None]
        assert (found[c]["n_rows"], found[c]["nulls"]) == (n, n - len(held))
        assert abs(found[c]["n_distinct"] - len(set(held))) <= 0.05 * len(set(held))
        counts = Counter(map(str, held))
        for v, k in found[c]["common"]:
            assert abs(counts[v] - k) <= 3.5 / 1024 * n
        if c == "skewed":
            held.sort()
            assert found[c]["bounds"][0] == held[0] and found[c]["bounds"][-1] == held[-1] and len(found[c]["bounds"]) == 21
            for i, b in enumerate(found[c]["bounds"]):
                assert bisect_left(held, b) - 0.02 * len(held) <= i / 20 * len(held) <= bisect_right(held, b) + 0.02 * len(held)
        else:
            assert found[c]["bounds"] is None
    assert found["skewed"]["common"][0]["value"] == "7" and found["many texts"]["common"][0]["value"] == "x" and found["nothing"]["common"] == [] and [tuple(x) for x in found["wide"]["common"]] == [("z", n - 9)]


def test_distribution_of_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "root"))
    first = store.import_archive(archive(tmp_path), min_rows=FEW)
    second = store.import_archive(archive(tmp_path, "ADDRESS_20240302030405.zip", rows={"SR": ["1;КИРОВА;ПЕР;;", "2;ЛЕНИНА;УЛ;;", "5;МИРА;УЛ;;"]}), min_rows=FEW)
    both = store.distribution([first, second]).where("table_name = 'street'")
    streets = {r["column_name"]: r for r in both.collect()}
    assert streets["id_street"]["n_rows"] == 5 and streets["id_street"]["n_distinct"] == 3 and streets["id_street"]["bounds"][-1] == 5
    assert [tuple(x) for x in streets["qualifier"]["common"]] == [("УЛ", 4), ("ПЕР", 1)]
    assert {r["n_rows"] for r in store.distribution([first]).where("table_name = 'street'").collect()} == {2}
    for wrong in ([], [first, 99]):
        with pytest.raises(ValueError):
            store.distribution(wrong)
    with pytest.raises(ValueError):
        store.distribution([first], common=1000)
    store.activate(second)
    assert store.prune(1) == [first]
    with pytest.raises(ValueError):
        store.distribution([first])
