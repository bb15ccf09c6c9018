"""Fuzzy address candidates: postal code, city, street and house against the address ranges of one version of a gazetteer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from ctypes import c_float
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.textnorm import house_match, house_match_score, norm_house, norm_text, ocr_norm_text, ocr_norm_text_value
from ..functions.trigram import THRESHOLD, similarity, similarity_to, trigrams
from ..sources.shared import written

#: Weights of the criteria. (Fixed values.)
WEIGHTS = {"postcode": Decimal("0.35"), "city": Decimal("0.25"), "street": Decimal("0.30"), "house": Decimal("0.10")}
COLUMNS = (
    "dataset_id", "id_address", "postal_code", "id_subject", "subject_name", "id_district", "district_name", "id_main_city", "main_city_name", "id_city", "city_name", "matched_city_name",
    "id_street", "street_name", "street_qualifier", "from_house_number", "to_house_number", "from_building_number", "to_building_number",
    "postcode_score", "city_score", "street_score", "house_score", "house_match", "score",
)
#: Columns of the address ranges that a search reads.
FACT = ("id_address", "postal_code", "post_office_name", "id_subject", "id_district", "id_main_city", "id_city", "id_street", "from_house_number", "to_house_number", "from_building_number", "to_building_number")
#: Names like a query's that are looked up before the search, so that the address ranges are not shuffled; with more of them they are joined as tables.
FEW_NAMES = 20_000


class InvalidQuery(ValueError):
    """A query that cannot be searched for."""


class NoActiveDataset(RuntimeError):
    """There is no version to search in."""


class Index(Protocol):
    """What finds names without reading them."""

    def near(self, table: str, value: str) -> DataFrame: ...


@dataclass(frozen=True)
class Gazetteer:
    """The tables of one version, and an index of its names, if there is one. Ids are unique within their table."""

    federal_subject: DataFrame
    district: DataFrame
    main_city: DataFrame
    city: DataFrame
    street: DataFrame
    address_range: DataFrame
    dataset_id: int | None = 1
    index: Index | None = None


def clamp_limit(limit: int | None) -> int:
    return min(max(20 if limit is None else limit, 1), 100)


def _norm(names: DataFrame, name: str) -> Column:
    """The normal form of a name: the stored one, where the table has it."""
    return F.col("name_norm") if "name_norm" in names.columns else norm_text(F.col(name))


def _near(names: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(id, sim) of the names like value. Only the name admits; the key word may raise the similarity."""
    held = "name_norm" if "name_norm" in names.columns else name
    listed = names.select(F.col(key).cast("long").alias("id"), F.col(held).alias("name"), F.col("lex_key1").alias("word"))
    # each distinct name is judged once, behind a shuffle: a table may come as one split. The count, which is always over 0, keeps conditions on a similarity from being moved below the grouping
    each = listed.groupBy("name", "word").agg(F.count(F.lit(1)).alias("held"))
    own = similarity_to(F.col("name") if held == "name_norm" else norm_text(F.col("name")), value)
    near = each.select("name", "word", *(F.when(F.col("held") > 0, sim).alias(c) for c, sim in (("own", own), ("key", similarity_to(ocr_norm_text(F.col("word")), value))))).where(F.col("own") >= F.lit(THRESHOLD))
    near = near.select(F.col("name").alias("n"), F.col("word").alias("w"), F.greatest("own", "key").alias("sim"))
    return listed.join(near, F.col("name").eqNullSafe(F.col("n")) & F.col("word").eqNullSafe(F.col("w"))).select("id", "sim")


#: Tables of names that are searched: key, name, and the criterion.
_NAMES = {"main_city": ("id_main_city", "main_city_name", "city"), "city": ("id_city", "city_name", "city"), "street": ("id_street", "street_name", "street")}


def _near_names(g: Gazetteer, given: dict[str, str]) -> dict[str, DataFrame | list[tuple[int, float]]]:
    """For each table that the query names: the list of (id, sim), or with more than FEW_NAMES of them the table (id, sim). One job for all."""
    near = {t: g.index.near(t, given[c]) if g.index else _near(getattr(g, t), key, name, given[c]) for t, (key, name, c) in _NAMES.items() if given[c]}
    if not near:
        return {}
    few = reduce(DataFrame.unionByName, (rows.limit(FEW_NAMES + 1).select(F.lit(t).alias("t"), "id", "sim") for t, rows in near.items())).collect()
    lists = {t: [(r["id"], r["sim"]) for r in few if r["t"] == t] for t in near}
    return {t: found if len(found) <= FEW_NAMES else near[t] for t, found in lists.items()}


def _table(spark: SparkSession, near: DataFrame | list[tuple[int, float]], key: str, sim: str) -> DataFrame:
    """near as (key, sim): a list, which has at most FEW_NAMES entries, is broadcast."""
    if isinstance(near, DataFrame):
        return near.select(F.col("id").alias(key), F.col("sim").alias(sim))
    return F.broadcast(spark.createDataFrame(near, f"{key} long, {sim} float"))


def _ranked() -> list[Column]:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).desc()
    return [F.col("score").desc(), zero("house_score"), zero("street_score"), zero("city_score"), F.col("id_address").asc()]


def _rank(r: Row) -> tuple:
    """_ranked for a row of the driver."""
    return (-r["score"], *(-(r[c] or 0.0) for c in ("house_score", "street_score", "city_score")), r["id_address"])


#: Dimensions of an address: table, key and what is shown of it.
_DIMENSIONS = {"federal_subject": ("id_subject", ["subject_name"]), "district": ("id_district", ["district_name"]), "main_city": ("id_main_city", ["main_city_name"]), "city": ("id_city", ["city_name"]), "street": ("id_street", ["street_name", "qualifier"])}


def _named(rows: DataFrame, g: Gazetteer, chosen: list[Row] | None = None) -> DataFrame:
    """rows with the names of their ids. Only the names of ids that rows have are kept of a dimension: of chosen rows of the driver by a literal filter, which the scan sees, otherwise by a semi-join; then they are few."""
    for table, (key, shown) in _DIMENSIONS.items():
        dimension = getattr(g, table).select(key, *shown)
        if chosen is None:
            held = dimension.join(rows.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
        else:
            ids = sorted({r[key] for r in chosen} - {None})
            held = F.broadcast(dimension.where(F.col(key).isin(ids) if ids else F.lit(False)))
        rows = rows.join(held, key, "left")
    rows = rows.withColumnRenamed("qualifier", "street_qualifier")
    return rows.withColumns({"matched_city_name": F.coalesce("city_name", "main_city_name", "post_office_name"), "house_match": house_match(F.col("house_score"))})


def _score(given: dict[str, str], value: Callable[[str], Column | float]) -> Column | float:
    """The weighted mean of the criteria that are given, before it is made a float; value gives each one's score as a double."""
    total = 0.0
    for name, weight in WEIGHTS.items():
        if given[name]:
            total = value(name) * float(weight) + total
    return total / float(sum(w for n, w in WEIGHTS.items() if given[n]))


def _scored(rows: DataFrame, given: dict[str, str], city: list[DataFrame] | None, street: DataFrame | None) -> DataFrame:
    """The address ranges that the criteria admit, with their scores. city: similarities of main cities and cities; None: not given."""
    none, zero = F.lit(None).cast("float"), F.lit(0.0).cast("float")
    if city:
        rows = rows.join(city[0], "id_main_city", "left").join(city[1], "id_city", "left").where("main_sim is not null or city_sim is not null")
        rows = rows.withColumn("city_score", F.greatest(F.coalesce("main_sim", zero), F.coalesce("city_sim", zero))).drop("main_sim", "city_sim")
    else:
        rows = rows.withColumn("city_score", none)
    rows = rows.join(street, "id_street") if street is not None else rows.withColumn("street_score", none)
    house = house_match_score(F.lit(given["house"]), F.col("from_house_number"), F.col("to_house_number")) if given["house"] else none
    rows = rows.withColumns({"postcode_score": F.lit(1.0).cast("float") if given["postcode"] else none, "house_score": house})
    score = _score(given, lambda n: F.coalesce(F.col(f"{n}_score").cast("double"), F.lit(0.0)))
    return rows.withColumn("score", score.cast("float"))


#: Names of the first tier of a search without a postal code, and how much larger each next one is.
TIER, TIER_GROWTH = 64, 16


def _best_first(rows: DataFrame, given: dict[str, str], near: dict, most: int, told: dict) -> list[Row]:
    """The best rows without a postal code, by tiers of the names of one criterion from the most alike downward.

    A row of a later tier has at most the similarity with which that tier begins; with the best that the other criteria can give, this bounds its score. When the worst of `most` rows found
    beats the bound, no later tier is read. A row that is met again in a later tier, by its other city, is worse there and has been counted.
    """
    spark = rows.sparkSession
    lead = sorted(((sim, t, i) for t in (("street",) if given["street"] else ("main_city", "city")) for i, sim in near[t]), reverse=True)
    tables = {"main_city": ("id_main_city", "main_sim"), "city": ("id_city", "city_sim"), "street": ("id_street", "street_score")}
    top = {"city": max((s for t in ("main_city", "city") if not isinstance(near.get(t, []), DataFrame) for _, s in near.get(t, [])), default=0.0), "house": 1.0}
    if any(isinstance(near.get(t), DataFrame) for t in ("main_city", "city")):
        top["city"] = 1.0
    best, at, size = {}, 0, TIER
    while at < len(lead):
        end = min(at + size, len(lead))
        while end < len(lead) and lead[end][0] == lead[end - 1][0]:
            end += 1
        tier = {t: [(i, sim) for sim, kind, i in lead[at:end] if kind == t] for t in tables}
        use = {t: _table(spark, tier[t] if t == "street" or not given["street"] else near[t], *tables[t]) for t in tables if given["street" if t == "street" else "city"]}
        read = Observation()
        admitted = _scored(rows, given, [use["main_city"], use["city"]] if given["city"] else None, use.get("street")).observe(read, F.count(F.lit(1)).alias("n"))
        for r in admitted.orderBy(*_ranked()).limit(most).collect():
            if r["id_address"] not in best or _rank(r) < _rank(best[r["id_address"]]):
                best[r["id_address"]] = r
        best = {r["id_address"]: r for r in sorted(best.values(), key=_rank)[:most]}
        told["tiers"], told["rows"] = told.get("tiers", 0) + 1, told.get("rows", 0) + read.get["n"]
        at, size = end, size * TIER_GROWTH
        if at < len(lead) and len(best) == most:
            bound = top | {"street" if given["street"] else "city": lead[at][0]}
            if min(r["score"] for r in best.values()) > c_float(_score(given, lambda n: bound[n])).value:  # noqa: B023
                break
    return sorted(best.values(), key=_rank)


def find_address_candidates(g: Gazetteer, postal_code: str | None = None, city: str | None = None, street: str | None = None, house: str | None = None, limit: int | None = 20, told: dict | None = None) -> DataFrame:
    """The best address ranges for one query, with the columns COLUMNS.

    Criteria that are not given neither filter nor count. A house alone is no query and never filters. Runs one job for the names and one for the search, or one for each tier of names where no postal code is given; at most
    100 rows come to the driver. told gets the number of tiers and of the rows that they admitted.
    """
    if g.dataset_id is None:
        raise NoActiveDataset("no active dataset")
    digits = re.sub("[^0-9]", "", postal_code or "")
    if (postal_code or "").strip(" ") and len(digits) != 6:
        raise InvalidQuery("a postal code has exactly 6 digits")
    v_city, v_street = ocr_norm_text_value(city), ocr_norm_text_value(street)
    v_house = re.sub("[^0-9А-ЯA-Z]+", "", ocr_norm_text_value(house))
    if not (digits or v_city or v_street):
        raise InvalidQuery("a query needs a postal code, a city or a street")
    given, spark, most = {"postcode": digits, "city": v_city, "street": v_street, "house": v_house}, g.address_range.sparkSession, clamp_limit(limit)
    near, rows = _near_names(g, given), g.address_range.select(*FACT)
    lead = ["street"] if v_street else ["main_city", "city"]
    if not digits and all(isinstance(near[t], list) for t in lead):
        best = _best_first(rows, given, near, most, {} if told is None else told)
    else:
        if digits:
            rows = rows.where(F.col("postal_code") == digits)
        cities = [_table(spark, near["main_city"], "id_main_city", "main_sim"), _table(spark, near["city"], "id_city", "city_sim")] if v_city else None
        best = _scored(rows, given, cities, _table(spark, near["street"], "id_street", "street_score") if v_street else None).orderBy(*_ranked()).limit(most).collect()
    types = {f.name: f.dataType.simpleString() for f in g.address_range.schema} | {f"{n}_score": "float" for n in WEIGHTS} | {"score": "float"}
    columns = [*FACT, *(f"{n}_score" for n in WEIGHTS), "score"]
    chosen = spark.createDataFrame([tuple(r[c] for c in columns) for r in best], ", ".join(f"{c} {types[c]}" for c in columns))
    return _named(chosen.withColumn("dataset_id", F.lit(g.dataset_id).cast("long")), g, best).orderBy(*_ranked()).select(*COLUMNS)


def near_names(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(kind, query, name, sim) of distinct normalised texts from (kind, query) and (kind, name) of one kind whose trigrams are alike.

    A self-contained set join: texts meet by trigrams of the query, the shared ones are counted, and sizes bound what can be alike. Any
    pair over the threshold shares one of the first n - ceil(0.3 n) + 1 trigrams of the query, in any order; with rare ones first, a stem that all names have meets nothing. No
    side has to be broadcast.
    """
    grams = lambda rows, c: rows.select("kind", c).where(F.col(c) != "").distinct().withColumn(f"{c}_grams", trigrams(F.col(c))).withColumn(f"{c}_size", F.size(f"{c}_grams"))
    asked = grams(queries, "query").withColumn("gram", F.explode("query_grams"))
    held = grams(names, "name").withColumn("gram", F.explode("name_grams"))
    often = held.join(asked.select("kind", "gram").distinct(), ["kind", "gram"], "left_semi").groupBy("kind", "gram").count()
    rare_first = Window.partitionBy("kind", "query").orderBy(F.coalesce("count", F.lit(0)), "gram")
    first = asked.join(often, ["kind", "gram"], "left").withColumn("place", F.row_number().over(rare_first)).where(F.col("place") <= F.col("query_size") - F.ceil(F.col("query_size") * 3 / 10) + 1)
    sizes = (F.col("query_size") * 3 <= F.col("name_size") * 10) & (F.col("name_size") * 3 <= F.col("query_size") * 10)
    pairs = first.drop("count", "place").join(held, ["kind", "gram"]).where(sizes).select("kind", "query", "name", similarity(F.col("query_grams"), F.col("name_grams")).alias("sim"))
    return pairs.where(F.col("sim") >= F.lit(THRESHOLD)).dropDuplicates(["kind", "query", "name"])


def _matches(g: Gazetteer, q: DataFrame) -> DataFrame:
    """(t, query, id, sim): _near for all distinct queries (q_city, q_street) and the tables of _NAMES."""
    asked = [q.select(F.lit(c).alias("kind"), F.col(f"q_{c}").alias("query")) for c in ("city", "street")]
    listed = reduce(DataFrame.unionByName, (
        getattr(g, t).select(F.lit(t).alias("t"), F.lit(c).alias("kind"), F.col(key).cast("long").alias("id"), _norm(getattr(g, t), name).alias("name"), ocr_norm_text(F.col("lex_key1")).alias("word"))
        for t, (key, name, c) in _NAMES.items()
    ))
    pairs = near_names(listed, asked[0].unionByName(asked[1])).join(listed, ["kind", "name"])
    raised = F.greatest(F.col("sim"), similarity(trigrams(F.col("word")), trigrams(F.col("query"))))
    return pairs.select("t", "query", "id", raised.alias("sim"))


#: Rows that a task gathers before it leaves all but the best of each query.
GATHERED = 20_000


def _best_of_task(most: int):
    """Of the rows of a task the best `most` of each query, by _ranked, held in bounded memory: no sort of all rows."""

    def cut(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        codes = rows["query_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices
        keys = pa.table({"q": codes, "score": rows["score"], **{c: pc.fill_null(rows[c], 0.0) for c in ("house_score", "street_score", "city_score")}, "id_address": rows["id_address"]})
        order = pc.sort_indices(keys, sort_keys=[("q", "ascending"), *((c, "descending") for c in keys.column_names[1:-1]), ("id_address", "ascending")]).to_numpy()
        own = codes.to_numpy(zero_copy_only=False)[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        place = np.arange(len(own)) - np.repeat(starts, np.diff([*starts, len(own)]))
        return rows.take(pa.array(order[place < most])).combine_chunks().to_batches()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= kept + max(GATHERED, kept):
                held = cut(held)
                n = kept = sum(b.num_rows for b in held)
        yield from cut(held) if held else ()

    return best


def candidates_batch(g: Gazetteer, queries: DataFrame, limit: int | None = 20) -> DataFrame:
    """find_address_candidates for a table of queries (query_id, postal_code, city, street, house): query_id, rank and COLUMNS.

    Queries that cannot be searched for have no rows. Each query leads by its narrowest criterion: postal code, then street, then city. The keys by which queries lead are joined with the address ranges in one pass over
    them; the other criteria test what came. The best rows of each query are chosen and written before names are looked up, so that only names of their ids are.
    """
    digits = F.regexp_replace(F.coalesce("postal_code", F.lit("")), "[^0-9]", "")
    q = queries.select("query_id", digits.alias("q_post"), (F.trim(F.coalesce("postal_code", F.lit(""))) != "").alias("asked"), ocr_norm_text(F.col("city")).alias("q_city"), ocr_norm_text(F.col("street")).alias("q_street"), norm_house(F.col("house")).alias("q_house"))
    q = q.where((~F.col("asked") | (F.length("q_post") == 6)) & ((F.col("q_post") != "") | (F.col("q_city") != "") | (F.col("q_street") != ""))).drop("asked")
    matched = written(_matches(g, q))
    of = lambda t, asked, key, sim: matched.where(F.col("t") == t).select(F.col("query").alias(asked), F.col("id").alias(key), F.col("sim").alias(sim))
    main, own, road = of("main_city", "q_city", "id_main_city", "main_sim"), of("city", "q_city", "id_city", "city_sim"), of("street", "q_street", "id_street", "street_sim")
    only_city = q.where("q_post = '' and q_street = ''")
    leads = [
        q.where("q_post <> ''").select("query_id", F.col("q_post").alias("postal_code")),
        q.where("q_post = '' and q_street <> ''").join(road, "q_street").select("query_id", "id_street"),
        only_city.join(main, "q_city").select("query_id", "id_main_city"),
        only_city.join(own, "q_city").select("query_id", "id_city"),
    ]
    rows, none = g.address_range.select(*FACT), F.array().cast("array<" + queries.schema["query_id"].dataType.simpleString() + ">")
    for n, lead in enumerate(leads):  # what leads by one key is one row, so that an address stays one row
        key = lead.columns[1]
        rows = rows.join(lead.groupBy(key).agg(F.collect_set("query_id").alias(f"by{n}")), key, "left").withColumn(f"by{n}", F.coalesce(f"by{n}", none))
    asking = F.array_distinct(F.concat(*(f"by{n}" for n in range(len(leads)))))
    rows = rows.where(reduce(lambda a, b: a | b, (F.size(f"by{n}") > 0 for n in range(len(leads))))).select(*FACT, F.explode(asking).alias("query_id")).join(q, "query_id")
    rows = rows.join(main, ["q_city", "id_main_city"], "left").join(own, ["q_city", "id_city"], "left").join(road, ["q_street", "id_street"], "left")
    rows = rows.where("(q_city = '' or main_sim is not null or city_sim is not null) and (q_street = '' or street_sim is not null)")
    zero = F.lit(0.0).cast("float")
    rows = rows.withColumns({
        "postcode_score": F.when(F.col("q_post") != "", F.lit(1.0).cast("float")),
        "city_score": F.when(F.col("q_city") != "", F.greatest(F.coalesce("main_sim", zero), F.coalesce("city_sim", zero))),
        "street_score": F.when(F.col("q_street") != "", F.col("street_sim")),
        "house_score": house_match_score(F.col("q_house"), F.col("from_house_number"), F.col("to_house_number")),
    })
    asked = {"postcode": "q_post", "city": "q_city", "street": "q_street", "house": "q_house"}
    total, weights = F.lit(0.0), F.lit(Decimal("0.00"))
    for name, weight in WEIGHTS.items():
        there = F.col(asked[name]) != ""
        total = total + F.when(there, F.lit(float(weight)) * F.coalesce(F.col(f"{name}_score").cast("double"), F.lit(0.0))).otherwise(0.0)
        weights = weights + F.when(there, F.lit(weight)).otherwise(F.lit(Decimal("0.00")))
    rows = rows.withColumns({"dataset_id": F.lit(g.dataset_id).cast("long"), "score": (total / weights.cast("double")).cast("float")})
    best = Window.partitionBy("query_id").orderBy(*_ranked())
    rows = rows.mapInArrow(_best_of_task(clamp_limit(limit)), rows.schema)
    rows = written(rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= clamp_limit(limit)))
    return _named(rows, g).select("query_id", "rank", *COLUMNS)
