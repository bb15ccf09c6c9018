"""Queries over the versioned store: versions made of the star-schema tables are imported, checked, activated and rolled back, and what the store then tells is a result.

The store of a session is made once for each folder of tables: version 1 holds all of them; version 2 breaks references and has too few districts, so it fails; version 3 has only every
other street and the addresses on them; at the end version 1 is active again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.textnorm import norm_text
from ..operators import candidates, images, recognised
from ..sources import name_index
from ..sources.shared import shared_dir
from ..sources.snapshot import SPECS, checksums, timestamp_column
from ..sources.store import Store
from .driver_tables import gazetteer, table
from .queries import _WORDS, ORACLE_SQL, QUERIES, SEARCHES, _documents, _shown, query, s_cyrillic, s_grams, s_house, s_house_score, s_norm, s_number, s_ocr, s_round4, s_sim

#: Stores of this process: (application, folder of tables) -> folder of the store and the ids of its versions.
_MADE: dict[tuple[str, str], tuple[str, list[int]]] = {}


def _version(spark: SparkSession, sf_dir: str, version: int) -> dict[str, DataFrame]:
    """The tables of a version, by their names in the contract."""
    g, none = gazetteer(spark, sf_dir), F.lit(None).cast("string")
    subject, district = F.col("id_subject"), F.col("id_district")
    if version == 2:
        subject, district = F.when(F.col("id_district") % 7 == 3, 99).otherwise(subject), F.when(F.col("id_district") % 5 == 4, -1).otherwise(district)
    street, facts = g.street, g.address_range
    if version == 3:
        street, facts = street.where("id_street % 2 = 0"), facts.where("id_street % 2 = 0")
    city_of = F.when(F.col("id_city") % 10 == 1, -5).otherwise(F.col("id_main_city")) if version == 2 else F.col("id_main_city")
    words = [none.alias("lex_key1"), none.alias("lex_key2")]
    postal = g.address_range.select("postal_code").distinct()
    return {
        "federal_subject": g.federal_subject.select("id_subject", "subject_name", *words),
        "district": g.district.select("id_district", subject.alias("id_subject"), "district_name", *words),
        "postal_code": postal.select("postal_code", *(F.lit(0).alias(c) for c in SPECS[2].names[1:])),
        "main_city": g.main_city.select("id_main_city", (F.col("id_district") % 5).alias("id_subject"), district.alias("id_district"), "main_city_name", *words),
        "city": g.city.select("id_city", city_of.alias("id_main_city"), "city_name", *words),
        "street": street.select("id_street", "street_name", "qualifier", "lex_key1", none.alias("lex_key2")),
        "address_range": facts.withColumns({"id_district": district, "even_odd_indicator": none}),
    }


#: Least rows of the versions made here; version 2 has to have more districts than it has.
_LEAST = dict.fromkeys([s.table for s in SPECS], 1)


def _store(spark: SparkSession, sf_dir: str) -> tuple[Store, list[int]]:
    """The store of a folder of tables. Its versions are imported as tables; archives are a matter of tests, where files can be made."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _MADE:
        root = shared_dir(spark).removeprefix("file://")
        store, ids = Store(spark, root), []
        for version in (1, 2, 3):
            name = f"ADDRESS_2024010{version}030405.zip"
            try:
                ids.append(store.import_tables(_version(spark, sf_dir, version), name, hashlib.sha256(name.encode()).hexdigest(), activate=True, min_rows=_LEAST | ({"district": 1000} if version == 2 else {})))
            except ValueError:
                ids.append(store.datasets()[0]["dataset_id"])
        store.activate(ids[0])
        _MADE[at] = root, ids
    root, ids = _MADE[at]
    store = Store(spark, root)
    store.register_views()
    return store, ids


_TABLES = {"federal_subject": "region", "district": "nation", "main_city": "supplier", "city": "customer", "street": "part", "address_range": "orders"}
_COUNTS = " UNION ALL ".join([*(f"SELECT '{n}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for n, t in _TABLES.items()), "SELECT 'postal_code', CAST(count(DISTINCT o_custkey % 10) AS BIGINT) FROM orders"])


@query(_COUNTS)
def S9_active_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each view of the active version (S2 to S5, M3, M6, J7: archive, contract, load, import, activation and rollback lie before it)."""
    _store(spark, sf_dir)
    return spark.sql(" UNION ALL ".join(f"SELECT '{s.table}' AS table_name, count(*) AS n_rows FROM current_{s.table}" for s in SPECS))


@query("SELECT CAST(1 AS BIGINT) AS dataset_id, 'ADDRESS_20240101030405.zip' AS source_filename, 'active' AS status, '2024-01-01T03:04:05+00:00' AS source_timestamp, CAST(count(*) AS BIGINT) AS addresses, CAST((SELECT count(*) FROM part) AS BIGINT) AS streets FROM orders")
def S9_active_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    _store(spark, sf_dir)
    count = lambda table, name: f"CAST(get_json_object(row_counts, '$.{table}') AS BIGINT) AS {name}"
    return spark.sql(f"SELECT dataset_id, source_filename, status, source_timestamp, {count('address_range', 'addresses')}, {count('street', 'streets')} FROM active_dataset")


@query(f"SELECT CAST(p_partkey AS INTEGER) AS id_street, {s_cyrillic('p_name')} AS street_name, {s_norm(s_cyrillic('p_name'))} AS name_norm, p_type AS qualifier FROM part WHERE p_partkey % 2 = 0")
def S8_version_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets of a version that is not the active one."""
    store, ids = _store(spark, sf_dir)
    return store.table("street", ids[2]).select("id_street", "street_name", "name_norm", "qualifier")


_KEPT_STREETS = "(SELECT count(*) FROM orders WHERE (o_orderkey % (SELECT count(*) FROM part)) % 2 = 0)"


@query(
    "SELECT CAST(1 AS BIGINT) AS dataset_id, 'active' AS status, CAST(count(*) AS BIGINT) AS addresses FROM orders UNION ALL SELECT 2, 'failed', CAST(count(*) AS BIGINT) FROM orders "
    f"UNION ALL SELECT 3, 'retired', CAST({_KEPT_STREETS} AS BIGINT)"
)
def S12_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _store(spark, sf_dir)
    return store.registry().select("dataset_id", "status", F.get_json_object("row_counts", "$.address_range").cast("long").alias("addresses"))


_BAD_DISTRICT = "CASE WHEN {0} % 5 = 4 THEN -1 ELSE {0} END"
_V6 = f"""
WITH f AS (SELECT o_custkey % 5 AS subject, {_BAD_DISTRICT.format('(o_custkey % 25)')} AS district FROM orders),
m AS (SELECT s_suppkey, {_BAD_DISTRICT.format('s_nationkey')} AS district FROM supplier),
v AS (SELECT 'address_reference_orphans' AS name, count(*) AS n FROM f WHERE district = -1
  UNION ALL SELECT 'district_subject_orphans', count(*) FROM nation WHERE n_nationkey % 7 = 3
  UNION ALL SELECT 'main_city_reference_orphans', count(*) FROM m WHERE district = -1
  UNION ALL SELECT 'city_main_city_orphans', count(*) FROM customer WHERE c_custkey % 10 = 1
  UNION ALL SELECT 'rows_DT', count(*) FROM nation UNION ALL SELECT 'rows_AR', count(*) FROM orders UNION ALL SELECT 'rows_PC', count(DISTINCT o_custkey % 10) FROM orders
  UNION ALL SELECT 'rows_FS', count(*) FROM region UNION ALL SELECT 'rows_MC', count(*) FROM supplier UNION ALL SELECT 'rows_CT', count(*) FROM customer UNION ALL SELECT 'rows_SR', count(*) FROM part)
SELECT name, CAST(n AS BIGINT) AS n FROM v
"""


@query(_V6)
def V6_validation_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validation of the broken version 2 counted (V1 to V6, J3 to J6, A1, A2), as the registry keeps it."""
    store, ids = _store(spark, sf_dir)
    record = store.registry().where(F.col("dataset_id") == ids[1]).select(F.from_json("validation", "map<string,string>").alias("v"))
    return record.select(F.explode("v").alias("name", "value")).where("name not in ('ok', 'errors')").select("name", F.col("value").cast("long").alias("n"))


@query("SELECT 'DT' AS what, 'row count ' || count(*) || ' below safety threshold 1000' AS said FROM nation UNION ALL SELECT 'address_range', 'broken' UNION ALL SELECT 'district', 'broken' UNION ALL SELECT 'main_city', 'broken' UNION ALL SELECT 'city', 'broken'")
def V1_thresholds_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of version 2: every violated threshold and every broken reference is named."""
    store, ids = _store(spark, sf_dir)
    record = store.registry().where(F.col("dataset_id") == ids[1]).select(F.explode(F.from_json(F.get_json_object("validation", "$.errors"), "array<string>")).alias("e"))
    low = F.col("e").contains("threshold")
    return record.select(F.when(low, F.substring_index("e", ":", 1)).otherwise(F.substring_index("e", " ", 1)).alias("what"), F.when(low, F.trim(F.substring_index("e", ":", -1))).otherwise("broken").alias("said"))


def _m4() -> str:
    g, parts = {"federal_subject": "region", "district": "nation", "postal_code": "(SELECT DISTINCT lpad(CAST(o_custkey % 10 AS VARCHAR), 6, '0') AS code FROM orders)", "main_city": "supplier", "city": "customer", "street": "part", "address_range": "orders"}, []
    empty = {"lex_key1", "lex_key2", "post_office_name", "from_building_number", "to_building_number", "even_odd_indicator"}
    keys = {"federal_subject": "r_regionkey", "district": "n_nationkey", "main_city": "s_suppkey", "city": "c_custkey", "street": "p_partkey", "address_range": "o_orderkey", "postal_code": "code"}
    for spec in SPECS:
        for c in spec.names:
            null = c in empty and not (spec.table == "street" and c == "lex_key1")
            low, high = (f"CAST(min({keys[spec.table]}) AS VARCHAR)", f"CAST(max({keys[spec.table]}) AS VARCHAR)") if c == spec.key else ("NULL", "NULL")
            parts.append(f"SELECT '{spec.table}' AS table_name, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST({'count(*)' if null else '0'} AS BIGINT) AS nulls, {low} AS key_low, {high} AS key_high FROM {g[spec.table]}")
    return " UNION ALL ".join(parts)


@query(_m4())
def M4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and nulls of all columns of the active version, and the range of the keys."""
    store, ids = _store(spark, sf_dir)
    keys = F.create_map(*(F.lit(x) for s in SPECS for x in (s.table, s.key)))
    own = F.col("column_name") == F.element_at(keys, F.col("table_name"))
    rows = store.statistics(ids[0])
    return rows.select("table_name", "column_name", "n_rows", "nulls", F.when(own, F.col("low")).alias("key_low"), F.when(own, F.col("high")).alias("key_high"))


def _m4_merged() -> dict[str, tuple[str, dict[str, str]]]:
    """Table -> (its rows of versions 1 and 3 together, column -> value as text) in SQL."""
    twice = lambda rows, kept="TRUE": f"(SELECT * FROM {rows} UNION ALL SELECT * FROM {rows} WHERE {kept})"
    facts, none, first = "o_orderkey % (SELECT count(*) FROM part)", "CAST(NULL AS VARCHAR)", "1 + o_orderkey % 50"
    words, no_flags = {"lex_key1": none, "lex_key2": none}, dict.fromkeys(SPECS[2].names[1:], "0")
    postal = "lpad(CAST(o_custkey % 10 AS VARCHAR), 6, '0')"
    return {
        "federal_subject": (twice("region"), {"id_subject": "r_regionkey", "subject_name": s_cyrillic("r_name"), **words}),
        "district": (twice("nation"), {"id_district": "n_nationkey", "id_subject": "n_regionkey", "district_name": s_cyrillic("n_name"), **words}),
        "postal_code": (twice(f"(SELECT DISTINCT {postal} AS code FROM orders)"), {"postal_code": "code", **no_flags}),
        "main_city": (twice("supplier"), {"id_main_city": "s_suppkey", "id_subject": "s_nationkey % 5", "id_district": "s_nationkey", "main_city_name": s_cyrillic("s_name"), **words}),
        "city": (twice("customer"), {"id_city": "c_custkey", "id_main_city": "c_custkey % (SELECT count(*) FROM supplier)", "city_name": s_cyrillic("c_name"), **words}),
        "street": (twice("part", "p_partkey % 2 = 0"), {"id_street": "p_partkey", "street_name": s_cyrillic("p_name"), "qualifier": "p_type", "lex_key1": s_cyrillic("p_brand"), "lex_key2": none}),
        "address_range": (twice("orders", f"({facts}) % 2 = 0"), {
            "id_address": "o_orderkey", "postal_code": postal, "post_office_name": none, "id_subject": "o_custkey % 5", "id_district": "o_custkey % 25", "id_main_city": "o_custkey % (SELECT count(*) FROM supplier)",
            "id_city": "o_custkey", "id_street": facts, "from_house_number": first, "to_house_number": f"{first} + 6", "from_building_number": none, "to_building_number": none, "even_odd_indicator": none,
        }),
    }


#: Columns with at most so many distinct values are shown value by value; for them, sketches are exact.
FEW = 300


def _m4_distribution() -> str:
    numbers, parts = {c.split()[0]: c.split()[1] in ("smallint", "int", "bigint") for s in SPECS for c in s.columns.split(", ")}, []
    for name, (rows, columns) in _m4_merged().items():
        for c, value in columns.items():
            low, high = (f"CAST({x} AS BIGINT)" for x in (("min(v)", "max(v)") if numbers[c] else ("NULL", "NULL")))
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(v) AS BIGINT) AS nulls, {low} AS low, {high} AS high, "
                         f"CAST(CASE WHEN count(DISTINCT v) <= {FEW} THEN count(DISTINCT v) END AS BIGINT) AS n_distinct FROM (SELECT {value} AS v FROM {rows})")  # fmt: skip
    return " UNION ALL ".join(parts)


@query(_m4_distribution())
def M4_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions taken together by their sketches: rows, nulls, lowest and highest number, and the number of distinct values where there are few."""
    store, ids = _store(spark, sf_dir)
    found = store.distribution([ids[0], ids[2]])
    return found.select("table_name", "column_name", "n_rows", "nulls", F.try_element_at("bounds", F.lit(1)).alias("low"), F.try_element_at("bounds", F.lit(-1)).alias("high"), F.when(F.col("n_distinct") <= FEW, F.col("n_distinct")).alias("n_distinct"))


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, CAST(v AS VARCHAR) AS value, n FROM (SELECT v, CAST(count(*) AS BIGINT) AS n, count(*) OVER () AS kinds FROM (SELECT {value} AS v FROM {rows}) WHERE v IS NOT NULL GROUP BY v) WHERE kinds <= {FEW}"
    for name, (rows, columns) in _m4_merged().items() for c, value in columns.items()
))
def M4_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value and its rows of the columns of two versions that have few values, by the merged sketches of frequent values."""
    store, ids = _store(spark, sf_dir)
    found = store.distribution([ids[0], ids[2]], common=FEW).where(F.col("n_distinct") <= FEW)
    return found.select("table_name", "column_name", F.inline("common"))


_AT = "TIMESTAMP '2001-02-03 04:05:06' + to_seconds(CAST(page_id * 7919 AS BIGINT))"


@query(f"SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS length, sha256(coalesce(html, '')) AS sha256, CAST(epoch(date_trunc('second', {_AT})) AS BIGINT) AS seconds FROM pages")
def S6_archive_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum, length and time of a file for each page, whose name has a time (S6, S7)."""
    when = F.date_format((F.lit(981_173_106) + F.col("page_id") * 7919).cast("timestamp"), "yyyyMMddHHmmss")
    content = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), F.col("page_id"), F.lit("/ADDRESS_"), when, F.lit(".zip")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return checksums(files).select(F.split("path", "/")[1].cast("long").alias("page_id"), "length", "sha256", F.col("source_timestamp").cast("long").alias("seconds"))


_NAME = "CASE WHEN o_orderkey % 3 = 0 THEN 'ADDRESS.zip' ELSE 'ADDRESS_' || {0} || '.zip' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', TIMESTAMP '2001-02-03 04:05:06' + to_seconds(CAST(o_orderkey * 7919 AS BIGINT)))) AS BIGINT) END AS seconds FROM orders")
def S7_timestamp_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.date_format((F.lit(981_173_106) + F.col("o_orderkey") * 7919).cast("timestamp"), "yyyyMMddHHmmss")
    name = F.when(F.col("o_orderkey") % 3 == 0, "ADDRESS.zip").otherwise(F.concat(F.lit("ADDRESS_"), when, F.lit(".zip")))
    return table(spark, sf_dir, "orders").select("o_orderkey", timestamp_column(name).cast("long").alias("seconds"))


# SQL functions -----------------------------------------------------------------------------------------------------------------

_SIM = s_sim(s_grams("p_name"), s_grams("p_brand"))
_SCORE = s_house_score("p_brand", "CAST(p_size AS VARCHAR)", "CAST(p_size + 5 AS VARCHAR)")


@query(
    f"SELECT p_partkey, {s_norm('p_name')} AS norm, {s_ocr('p_name')} AS ocr, {s_house('p_brand')} AS house, {s_number('CAST(p_size AS VARCHAR)')} AS number, "
    f"CAST(round({_SIM}::DOUBLE * 10000) AS BIGINT) AS sim_e4, CAST(round({_SCORE}::DOUBLE * 10000) AS BIGINT) AS house_e4 FROM part"
)
def E1_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 to E5 called by their names in SQL."""
    sql.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("__parts")
    return spark.sql(
        "SELECT p_partkey, norm_text(p_name) AS norm, ocr_norm_text(p_name) AS ocr, norm_house(p_brand) AS house, house_leading_number(CAST(p_size AS STRING)) AS number, "
        "CAST(round(CAST(similarity(p_name, p_brand) AS DOUBLE) * 10000) AS BIGINT) AS sim_e4, "
        "CAST(round(CAST(house_match_score(p_brand, CAST(p_size AS STRING), CAST(p_size + 5 AS STRING)) AS DOUBLE) * 10000) AS BIGINT) AS house_e4 FROM __parts"
    )


_E4 = ("postcode_score", "city_score", "street_score", "house_score", "score")
_SHOWN = "id_address, postal_code, subject_name, district_name, main_city_name, city_name, matched_city_name, street_name, street_qualifier, from_house_number, to_house_number, house_match"


@query(ORACLE_SQL["candidates_full"])
def E8_sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a table function over the active version, with what it shows of an address."""
    _store(spark, sf_dir)
    e4 = ", ".join(f"CAST(round(CAST({c} AS DOUBLE) * 10000) AS BIGINT) AS {c}_e4" for c in _E4)
    return spark.sql(f"SELECT {_SHOWN}, {e4} FROM find_address_candidates('000003', 'ЦУСТОМЕР#000000003', 'СМАЛЛ РИНГГ', '4')")


# Index and bounds of the search ------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, CAST(round(sim::DOUBLE * 10000) AS BIGINT) AS sim_e4 FROM (SELECT p_partkey, {s_sim(s_grams(s_norm('p_name')), s_grams(chr(39) + 'RED WIDGIT' + chr(39)))} AS sim FROM part) WHERE sim >= CAST(0.3 AS FLOAT)")
def K4_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names like a value by an index written from the names, which the search itself does not read (P2, K4)."""
    part = table(spark, sf_dir, "part")
    path = shared_dir(spark)
    name_index.write(name_index.names_of({"part": (part, "p_partkey", norm_text(F.col("p_name")), F.lit(None).cast("string"))}), path)
    found = name_index.NameIndex(spark, path).near("part", "RED WIDGIT")
    return found.select(F.col("id").alias("p_partkey"), F.round(F.col("sim").cast("double") * 10000).cast("long").alias("sim_e4"))


def _store_search(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store, _ = _store(spark, sf_dir)
        return _shown(candidates.find_address_candidates(store.gazetteer(), *SEARCHES[name]))

    run.__doc__ = "The search over the active version, with the persisted index of its names and, without a postal code, tiers of names from the most alike downward (K1, P2)."
    return run


for _name in SEARCHES:
    QUERIES[f"K1_store_{_name}"] = _store_search(_name)
    ORACLE_SQL[f"K1_store_{_name}"] = ORACLE_SQL[_name]


# Recognised text ---------------------------------------------------------------------------------------------------------------


_CONF = "(CAST((l_partkey * 7919 + l_suppkey * 31 + l_linenumber * 13) % 100005 AS DOUBLE) / 1000.0::DOUBLE)"


@query(
    f"WITH w AS (SELECT l_orderkey, {_CONF} AS conf, 1 + l_suppkey % 9 AS w FROM lineitem), "
    f"k AS (SELECT l_orderkey, w, {s_round4('least(conf / 100.0::DOUBLE, 1.0::DOUBLE)')} AS e4 FROM w), "
    f"t AS (SELECT l_orderkey, CAST(sum(e4 * w) AS DOUBLE) / (CAST(sum(w) AS DOUBLE) * 10000.0::DOUBLE) AS mean FROM k GROUP BY l_orderkey) SELECT l_orderkey, {s_round4('mean')} AS conf_e4 FROM t"
)
def A4_weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line confidences of words whose confidences have three decimals, so that rounding decides (E10, P10)."""
    rows = table(spark, sf_dir, "lineitem")
    conf = ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31 + F.col("l_linenumber") * 13) % 100005).cast("double") / 1000.0
    zero = F.lit(0)
    words = rows.select(
        F.col("l_orderkey").alias("image_id"), F.lit("gray").alias("mode"), F.col("l_linenumber").alias("idx"), F.repeat(F.lit("x"), (1 + F.col("l_suppkey") % 9).cast("int")).alias("text"), conf.alias("conf"),
        *(zero.alias(c) for c in ("left", "top", "width", "height", "block_num", "par_num", "line_num")),
    )
    return recognised.lines(recognised.kept_words(words)).select(F.col("image_id").alias("l_orderkey"), recognised.confidence().alias("conf_e4"))


@query("SELECT user_id AS image_id, CAST(round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 3) AS DOUBLE) AS ocr_ms, CAST(count(*) AS BIGINT) AS attempts FROM events GROUP BY user_id")
def A8_attempt_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised.times(table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("value").alias("ocr_ms")))


@query(f"WITH {_WORDS} SELECT image_id, mode, CAST(CASE mode WHEN 'gray' THEN 1 ELSE 2 END AS INTEGER) AS place, md5(text) AS text_md5, CAST(conf_e4 AS BIGINT) AS conf_e4 FROM every")
def I7_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt of an image, in the order of the modes."""
    rows = recognised.alternatives(_documents(spark, sf_dir).withColumnRenamed("text_md5", "text")).select("image_id", F.posexplode("alternatives").alias("place", "a"))
    return rows.select("image_id", "a.mode", (F.col("place") + 1).alias("place"), F.col("a.text").alias("text_md5"), "a.conf_e4")


_WIDE, _HIGH = "(1000 + page_id * 37 % 9000)", "(1000 + page_id * 91 % 9000)"


@query(f"SELECT page_id, CAST(CASE WHEN page_id % 7 = 2 THEN 400 WHEN page_id % 7 = 3 THEN 415 WHEN {_WIDE} * {_HIGH} > 40000000 THEN 413 ELSE 200 END AS INTEGER) AS status FROM pages")
def S10_image_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with PNG, JPEG, no, other, BMP and TIFF content of both byte orders; a JPEG file's frame comes after a comment with the page's text."""
    wide, high = (F.lit(1000) + F.col("page_id") * k % 9000 for k in (37, 91))
    big = lambda n, size=8: F.lpad(F.hex(n), size, "0")
    little = lambda n: F.concat(*(F.substring(big(n), k, 2) for k in (7, 5, 3, 1)))
    text = F.substring(F.hex(F.encode(F.coalesce("html", F.lit("")), "utf-8")), 1, 40_000)
    comment = F.concat(F.lit("FFFE"), big((2 + F.length(text) / 2).cast("long"), 4), text)
    kinds = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(wide), big(high), F.lit("0802000000")),
        F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), comment, F.lit("FFC4000400"), F.lit("FFFFC0001108"), big(high, 4), big(wide, 4), F.lit("03011100021101031101")),
        F.lit(""),
        F.concat(F.lit("78"), text),
        F.concat(F.lit("424D" + "00" * 12 + "28000000"), little(wide), little(high)),
        F.concat(F.lit("49492A0008000000" + "0300" + "FE00040001000000" + "00000000" + "0001040001000000"), little(wide), F.lit("0101040001000000"), little(high)),
        F.concat(F.lit("4D4D002A"), big(F.lit(8)), F.lit("0002" + "0100000300000001"), big(wide, 4), F.lit("0000" + "0101000300000001"), big(high, 4), F.lit("0000")),
    ]
    content = F.unhex(F.get(F.array(*kinds), (F.col("page_id") % 7).cast("int")))
    files = table(spark, sf_dir, "pages").select("page_id", content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return images.checked(files).select("page_id", "status")


_GRAY = "CAST(least(greatest(128 + floor(256 * x::DOUBLE), 0), 255) AS BIGINT)"


@query(f"""
WITH p AS (SELECT vec_id, {_GRAY} AS g FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)),
c AS (SELECT vec_id, g, count(*) AS k, sum(count(*)) OVER (PARTITION BY vec_id) AS n, sum(g * count(*)) OVER (PARTITION BY vec_id) AS total, sum(count(*)) OVER (PARTITION BY vec_id ORDER BY g) AS w, sum(g * count(*)) OVER (PARTITION BY vec_id ORDER BY g) AS s FROM p GROUP BY vec_id, g),
d AS (SELECT vec_id, g, s::DOUBLE * n::DOUBLE - total::DOUBLE * w::DOUBLE AS apart, w::DOUBLE * (n - w)::DOUBLE AS both_sides FROM c WHERE w < n),
t AS (SELECT vec_id, coalesce((SELECT g FROM d WHERE d.vec_id = e.vec_id ORDER BY apart * apart / both_sides DESC, g LIMIT 1), 0) AS threshold FROM embeddings e)
SELECT t.vec_id, CAST(threshold AS INTEGER) AS threshold, CAST(count(*) FILTER (g > threshold) AS BIGINT) AS white FROM t JOIN p ON p.vec_id = t.vec_id GROUP BY t.vec_id, threshold
""")
def I3_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's threshold of each embedding as an image of 8 x 8 pixels, and how many pixels become white."""
    gray = F.least(F.greatest(F.lit(128) + F.floor(F.col("x").cast("double") * 256), F.lit(0)), F.lit(255)).cast("int")
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x")).select("vec_id", gray.alias("gray"))
    return images.binarised(pixels, "vec_id").groupBy("vec_id", "threshold").agg(F.count_if(F.col("white") == 255).alias("white"))


_WEIGHTS = ", ".join(f"({d - images.BLOCK // 2}, {w})" for d, w in enumerate(images.gaussian_weights()))
_ROUND = "CAST(({0} + 2147483648) // 4294967296 AS BIGINT)"


@query(f"""
WITH w(d, weight) AS (VALUES {_WEIGHTS}),
p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, {_GRAY} AS g FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)),
h AS (SELECT p.vec_id, p.y, p.x, p.g, sum(CAST(weight AS BIGINT) * q.g) AS s FROM p CROSS JOIN w JOIN p q ON q.vec_id = p.vec_id AND q.y = p.y AND q.x = least(greatest(p.x + d, 0), 7) GROUP BY ALL),
v AS (SELECT h.vec_id, h.y, h.x, h.g, CAST(sum(weight * q.s) AS BIGINT) AS s FROM h CROSS JOIN w JOIN h q ON q.vec_id = h.vec_id AND q.x = h.x AND q.y = least(greatest(h.y + d, 0), 7) GROUP BY ALL)
SELECT vec_id, CAST(count(*) FILTER (white) AS BIGINT) AS white, CAST(coalesce(sum((y * 8 + x + 1) * (y * 8 + x + 1)) FILTER (white), 0) AS BIGINT) AS places
FROM (SELECT *, g > {_ROUND.format('s')} - {images.DARKER} AS white FROM v) GROUP BY vec_id
""")
def I3_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive threshold on each embedding as an image of 8 x 8 pixels: how many pixels become white, and which (their squared places)."""
    gray = F.least(F.greatest(F.lit(128) + F.floor(F.col("x").cast("double") * 256), F.lit(0)), F.lit(255)).cast("int")
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).alias("col"), gray.alias("gray"))
    place, white = F.col("row") * 8 + F.col("col") + 1, F.col("white") == 255
    return images.adaptive(pixels, "vec_id").groupBy("vec_id").agg(F.count_if(white).alias("white"), F.coalesce(F.sum(F.when(white, place * place)), F.lit(0)).cast("long").alias("places"))


@query(f"""
WITH p AS (SELECT vec_id // 16 AS image_id, (vec_id % 16) // 4 * 8 + i // 8 AS y, vec_id % 4 * 8 + i % 8 AS x, {_GRAY} // 2 AS g0 FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)),
g AS (SELECT image_id, y, x, CASE WHEN abs(16 * (y - 16) - (image_id % 13 - 4) * (x - 16)) <= 60 + image_id % 5 * 20 THEN g0 ELSE 255 END AS g FROM p),
c AS (SELECT image_id, g, count(*) AS k, sum(count(*)) OVER (PARTITION BY image_id) AS n, sum(g * count(*)) OVER (PARTITION BY image_id) AS total, sum(count(*)) OVER (PARTITION BY image_id ORDER BY g) AS w, sum(g * count(*)) OVER (PARTITION BY image_id ORDER BY g) AS s FROM g GROUP BY image_id, g),
d AS (SELECT image_id, g, s::DOUBLE * n::DOUBLE - total::DOUBLE * w::DOUBLE AS apart, w::DOUBLE * (n - w)::DOUBLE AS both_sides FROM c WHERE w < n),
t AS (SELECT image_id, coalesce(arg_min(g, {{'a': -(apart * apart / both_sides), 'g': g}}), 0) AS threshold FROM d GROUP BY image_id),
dark AS (SELECT g.image_id, y, x FROM g LEFT JOIN t ON t.image_id = g.image_id WHERE g <= coalesce(threshold, 0)),
n AS (SELECT image_id, count(*) AS n_dark FROM dark GROUP BY image_id),
ends AS (SELECT image_id, y, unnest([min(x), max(x)]) AS x FROM dark GROUP BY image_id, y),
pts AS (SELECT DISTINCT * FROM ends),
lines AS (SELECT a.image_id, b.x - a.x AS dx, b.y - a.y AS dy, min((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)) AS inner_least,
  (max((b.x - a.x) * r.x + (b.y - a.y) * r.y) - min((b.x - a.x) * r.x + (b.y - a.y) * r.y))::DOUBLE * (max((b.x - a.x) * r.y - (b.y - a.y) * r.x) - min((b.x - a.x) * r.y - (b.y - a.y) * r.x))::DOUBLE AS sides
  FROM pts a JOIN pts b ON b.image_id = a.image_id AND (b.x <> a.x OR b.y <> a.y) JOIN pts r ON r.image_id = a.image_id GROUP BY a.image_id, a.x, a.y, b.x, b.y),
rects AS (SELECT image_id, sides / (dx * dx + dy * dy)::DOUBLE AS area, CASE WHEN dx = 0 OR dy = 0 THEN 90.0::DOUBLE WHEN dx > 0 AND dy > 0 THEN degrees(atan2(dy, dx)) WHEN dx < 0 AND dy > 0 THEN degrees(atan2(-dx, dy)) WHEN dx < 0 THEN degrees(atan2(-dy, -dx)) ELSE degrees(atan2(dx, -dy)) END AS angle FROM lines WHERE inner_least >= 0),
best AS (SELECT image_id, arg_min(angle, {{'a': area, 'g': angle}}) AS rect FROM rects GROUP BY image_id)
SELECT i.image_id, CAST(coalesce(n_dark, 0) AS BIGINT) AS n_dark, CAST(CASE WHEN n_dark >= {images.FEWEST} AND rect BETWEEN {images.LEAST_ANGLE} AND {images.MOST_ANGLE} THEN round(-rect * 1000) ELSE 0 END AS BIGINT) AS angle_e3
FROM (SELECT DISTINCT image_id FROM g) i LEFT JOIN n ON n.image_id = i.image_id LEFT JOIN best ON best.image_id = i.image_id
""")
def I2_skew_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle to turn images by: 16 embeddings each are an image of 32 x 32 pixels with a tilted band of ink on white."""
    level = F.least(F.greatest(F.lit(128) + F.floor(F.col("v").cast("double") * 256), F.lit(0)), F.lit(255)).cast("int")
    image, tile = F.floor(F.col("vec_id") / 16), F.col("vec_id") % 16
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    cells = cells.select(image.alias("image_id"), (F.floor(tile / 4) * 8 + F.floor(F.col("i") / 8)).alias("row"), (tile % 4 * 8 + F.col("i") % 8).alias("col"), F.floor(level / 2).alias("ink"))
    inside = F.abs(16 * (F.col("row") - 16) - (F.col("image_id") % 13 - 4) * (F.col("col") - 16)) <= 60 + F.col("image_id") % 5 * 20
    found = images.skew_angles(cells.select("image_id", "row", "col", F.when(inside, F.col("ink")).otherwise(255).cast("int").alias("gray")))
    return found.select("image_id", "n_dark", F.round(F.col("angle") * 1000).cast("long").alias("angle_e3"))
