"""The normal forms, house scores, similarity and the address search as functions of a session's SQL.

After `register(spark)`: norm_text, ocr_norm_text, norm_house, house_leading_number, house_match_score, similarity and, over the views current_<table>, the table function
find_address_candidates(postal, city, street, house, most) with the columns RESULT. They are temporary SQL functions, so Catalyst puts their bodies into the plan. The search refuses, in this order, every query while
there is no active version, a postal code that has not six digits, and a query without postal code, city and street.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .textnorm import CYRILLIC, LATIN, SEVERAL
from .trigram import THRESHOLD

_BLANKS = " " * len(SEVERAL)
#: name(arguments) returns type: body
SCALARS = (
    ("norm_text(v STRING) RETURNS STRING", f"trim(regexp_replace(upper(translate(coalesce(v, ''), 'Ё{SEVERAL}', 'Е{_BLANKS}')), '[^0-9A-ZА-Я-]+', ' '))"),
    ("ocr_norm_text(v STRING) RETURNS STRING", f"translate(norm_text(v), '{LATIN}', '{CYRILLIC}')"),
    ("norm_house(v STRING) RETURNS STRING", "regexp_replace(ocr_norm_text(v), '[^0-9А-ЯA-Z]+', '')"),
    ("house_leading_number(v STRING) RETURNS BIGINT", "CAST(nullif(regexp_extract(norm_house(v), '^[0-9]+', 0), '') AS BIGINT)"),
    (
        "house_match_score(house STRING, first STRING, last STRING) RETURNS FLOAT",
        "CAST(CASE WHEN norm_house(house) = '' THEN NULL WHEN norm_house(house) IN (norm_house(first), norm_house(last)) THEN 1.0 "
        "WHEN house_leading_number(house) BETWEEN least(house_leading_number(first), house_leading_number(last)) AND greatest(house_leading_number(first), house_leading_number(last)) "
        "AND house_leading_number(first) IS NOT NULL AND house_leading_number(last) IS NOT NULL THEN 0.95 ELSE 0.0 END AS FLOAT)",
    ),
    (
        "trigrams(v STRING) RETURNS ARRAY<STRING>",
        "array_distinct(flatten(transform(filter(split(lower(coalesce(v, '')), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    ),
    (
        "similarity(a STRING, b STRING) RETURNS FLOAT",
        "CAST(CASE WHEN size(trigrams(a)) + size(trigrams(b)) > 0 THEN size(array_intersect(trigrams(a), trigrams(b))) / (size(trigrams(a)) + size(trigrams(b)) - size(array_intersect(trigrams(a), trigrams(b)))) "
        "ELSE 0 END AS FLOAT)",
    ),
)


def _given(name: str, weight: str, present: str) -> tuple[str, str]:
    return f"CASE WHEN {present} THEN {weight}D * coalesce(CAST({name}_score AS DOUBLE), 0D) ELSE 0D END", f"CASE WHEN {present} THEN {weight} ELSE 0 END"


#: Result of the search: columns and their types. (Fixed values.)
RESULT = (
    "dataset_id BIGINT, id_address BIGINT, postal_code STRING, id_subject INT, subject_name STRING, id_district INT, district_name STRING, id_main_city INT, main_city_name STRING, id_city INT, city_name STRING, "
    "matched_city_name STRING, id_street INT, street_name STRING, street_qualifier STRING, from_house_number STRING, to_house_number STRING, from_building_number STRING, to_building_number STRING, "
    "postcode_score FLOAT, city_score FLOAT, street_score FLOAT, house_score FLOAT, house_match BOOLEAN, score FLOAT"
)
_ARGUMENTS = "postal STRING DEFAULT NULL, city STRING DEFAULT NULL, street STRING DEFAULT NULL, house STRING DEFAULT NULL, most INT DEFAULT 20"
_POST = "regexp_replace(coalesce(postal, ''), '[^0-9]', '')"
NO_DATASET = "no active dataset"


def _refusal(condition: str) -> str:
    """A branch without rows that raises an error where the condition does; with constant arguments that are in order it is folded away."""
    columns = ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in RESULT.split(", "))
    return f"SELECT {columns} FROM (SELECT 1) WHERE {condition}"


def _search() -> str:
    # each distinct name is judged once, behind a shuffle: a table may come as one split. The count, which is always over 0, keeps conditions on a similarity from being moved below the grouping
    names = lambda table: f"(SELECT name_norm, lex_key1, count(*) AS held FROM current_{table} GROUP BY name_norm, lex_key1)"
    alike = lambda table, value: f"(SELECT name_norm, lex_key1, CASE WHEN held > 0 THEN greatest(similarity(name_norm, {value}), similarity(ocr_norm_text(lex_key1), {value})) END AS sim FROM {names(table)} WHERE CASE WHEN held > 0 THEN similarity(name_norm, {value}) >= CAST({THRESHOLD} AS FLOAT) END)"
    near = lambda table, key, value: f"(SELECT t.{key}, n.sim FROM current_{table} t JOIN {alike(table, value)} n ON n.name_norm = t.name_norm AND n.lex_key1 <=> t.lex_key1)"
    city, street, house = "ocr_norm_text(city)", "ocr_norm_text(street)", "norm_house(house)"
    parts = [_given("postcode", "0.35", f"{_POST} <> ''"), _given("city", "0.25", f"{city} <> ''"), _given("street", "0.30", f"{street} <> ''"), _given("house", "0.10", f"{house} <> ''")]
    score = f"CAST(({' + '.join(['0D', *(a for a, _ in parts)])}) / nullif(CAST({' + '.join(b for _, b in parts)} AS DOUBLE), 0D) AS FLOAT)"
    order = "score DESC, coalesce(house_score, 0F) DESC, coalesce(street_score, 0F) DESC, coalesce(city_score, 0F) DESC, id_address"
    refused = f"CASE WHEN trim(coalesce(postal, '')) <> '' AND length({_POST}) <> 6 THEN CAST(raise_error('a postal code has exactly 6 digits') AS BOOLEAN) WHEN {_POST} = '' AND {city} = '' AND {street} = '' THEN CAST(raise_error('a query needs a postal code, a city or a street') AS BOOLEAN) ELSE false END"
    return f"""
WITH base AS (SELECT f.*, CASE WHEN {_POST} <> '' THEN CAST(1.0 AS FLOAT) END AS postcode_score,
    CASE WHEN {city} <> '' THEN greatest(coalesce(m.sim, 0F), coalesce(c.sim, 0F)) END AS city_score, CASE WHEN {street} <> '' THEN s.sim END AS street_score,
    house_match_score(house, f.from_house_number, f.to_house_number) AS house_score
  FROM current_address_range f LEFT JOIN {near("main_city", "id_main_city", city)} m ON m.id_main_city = f.id_main_city
    LEFT JOIN {near("city", "id_city", city)} c ON c.id_city = f.id_city LEFT JOIN {near("street", "id_street", street)} s ON s.id_street = f.id_street
  WHERE ({_POST} = '' OR f.postal_code = {_POST}) AND ({city} = '' OR m.sim IS NOT NULL OR c.sim IS NOT NULL) AND ({street} = '' OR s.sim IS NOT NULL) AND {_POST} || {city} || {street} <> ''),
scored AS (SELECT *, {score} AS score FROM base),
first AS (SELECT * FROM scored ORDER BY {order} LIMIT 100),
placed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM first),
best AS (SELECT * FROM placed WHERE place <= least(greatest(coalesce(most, 20), 1), 100)),
named AS (SELECT b.dataset_id, b.id_address, b.postal_code, b.id_subject, fs.subject_name, b.id_district, dt.district_name, b.id_main_city, mc.main_city_name, b.id_city, ct.city_name,
    coalesce(ct.city_name, mc.main_city_name, b.post_office_name) AS matched_city_name, b.id_street, st.street_name, st.qualifier AS street_qualifier, b.from_house_number, b.to_house_number, b.from_building_number, b.to_building_number,
    b.postcode_score, b.city_score, b.street_score, b.house_score, CAST(b.house_score AS DOUBLE) >= 0.95D AS house_match, b.score
  FROM best b LEFT JOIN current_federal_subject fs ON fs.id_subject = b.id_subject LEFT JOIN current_district dt ON dt.id_district = b.id_district LEFT JOIN current_main_city mc ON mc.id_main_city = b.id_main_city
    LEFT JOIN current_city ct ON ct.id_city = b.id_city LEFT JOIN current_street st ON st.id_street = b.id_street)
SELECT * FROM named UNION ALL {_refusal(refused)}"""


def register(spark: SparkSession) -> None:
    """Registers the functions for the session. Without the views of an active version the search refuses every query."""
    for head, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    ready = spark.catalog.tableExists("current_address_range")
    body = _search() if ready else _refusal(f"coalesce(postal, city, street, house, CAST(most AS STRING), '') IS NOT NULL AND CAST(raise_error('{NO_DATASET}') AS BOOLEAN)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION find_address_candidates({_ARGUMENTS}) RETURNS TABLE ({RESULT}) RETURN {body}")
