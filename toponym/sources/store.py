"""A versioned gazetteer on Parquet: one folder per table with a partition per version, a small registry, and the active version.

The registry is one JSON file that is replaced as a whole; that replacement is the commit of every change, so readers see a
version completely or not at all. Changes hold a file lock. The folder has to be a file system path.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.textnorm import norm_text, ocr_norm_text
from ..operators.candidates import Gazetteer, NoActiveDataset
from ..operators.validation import repeated_keys, validate
from . import distribution, name_index
from .name_index import NameIndex
from .snapshot import SPECS, Spec, members, read_table, sha256_of, timestamp_of, typed

#: Tables that may be large.
_SPREAD = ("main_city", "city", "street", "address_range")
#: States whose versions count for retention.
KEPT = ("active", "retired", "ready")


def to_prune(registry: DataFrame, keep: int) -> DataFrame:
    """The rows of a registry (dataset_id, status) that pruning deletes: kept states beyond the newest `keep`, never the active one."""
    if keep < 1:
        raise ValueError("keep has to be 1 or more")
    rows = registry.where(F.col("status").isin(*KEPT))
    newest = rows.orderBy(F.desc("dataset_id")).limit(keep).select("dataset_id")
    return rows.where("status <> 'active'").join(newest, "dataset_id", "left_anti")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @contextmanager
    def _locked(self) -> Iterator[None]:
        with (self.root / "lock").open("w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def _read(self) -> dict:
        path = self.root / "registry.json"
        return json.loads(path.read_text()) if path.exists() else {"active": None, "datasets": []}

    def _write(self, state: dict) -> None:
        new = self.root / f".registry-{uuid.uuid4().hex}"
        new.write_text(json.dumps(state, ensure_ascii=False))
        os.replace(new, self.root / "registry.json")

    def datasets(self) -> list[dict]:
        """All versions, the newest first."""
        return sorted(self._read()["datasets"], key=lambda d: -d["dataset_id"])

    def registry(self) -> DataFrame:
        told = ("source_timestamp", "imported_at", "activated_at", "error_text")
        rows = [(d["dataset_id"], d["status"], d["source_filename"], d["source_sha256"], json.dumps(d.get("row_counts")), json.dumps(d.get("validation")), *map(d.get, told)) for d in self.datasets()]
        return self.spark.createDataFrame(rows, "dataset_id long, status string, source_filename string, source_sha256 string, row_counts string, validation string, " + ", ".join(f"{t} string" for t in told))

    def _update(self, dataset_id: int, **values) -> None:
        state = self._read()
        next(d for d in state["datasets"] if d["dataset_id"] == dataset_id).update(values)
        self._write(state)

    def import_archive(self, path: str, activate: bool = False, min_rows: dict[str, int] | None = None) -> int:
        """Loads an archive as a new version and validates it; returns its id. The same file again is an error unless it failed before. Executors unpack the archive; nothing is staged."""
        with zipfile.ZipFile(path) as archive:
            members(archive)
        read = lambda spec, dataset_id: read_table(self.spark, spec, str(Path(path).absolute()), dataset_id)
        return self._import(read, Path(path).name, sha256_of(Path(path)), timestamp_of(Path(path).name), activate, min_rows)

    def import_tables(self, tables: dict[str, DataFrame], name: str, digest: str, activate: bool = False, min_rows: dict[str, int] | None = None) -> int:
        """Loads tables with the columns of the contract as a new version, like an archive of that name whose contents have the digest."""
        return self._import(lambda spec, dataset_id: typed(tables[spec.table], spec, dataset_id), name, digest, timestamp_of(name), activate, min_rows)

    def _import(self, read: Callable[[Spec, int], DataFrame], name: str, digest: str, when: datetime | None, activate: bool, min_rows: dict[str, int] | None) -> int:
        with self._locked():
            state = self._read()
            same = [d for d in state["datasets"] if d["source_sha256"] == digest]
            if any(d["status"] != "failed" for d in same):
                raise ValueError(f"this archive is dataset {same[0]['dataset_id']} already, with status {same[0]['status']}")
            for d in same:
                self._delete(d["dataset_id"])
            dataset_id = max((d["dataset_id"] for d in state["datasets"]), default=0) + 1
            state["datasets"] = [d for d in state["datasets"] if d not in same]
            state["datasets"].append({"dataset_id": dataset_id, "source_filename": name, "source_sha256": digest, "source_timestamp": when and when.isoformat(), "status": "loading", "imported_at": datetime.now(UTC).isoformat()})
            self._write(state)
            try:
                with ThreadPoolExecutor(len(SPECS)) as pool:  # jobs of small tables fill the cores that the last tasks of large ones leave
                    observed = dict(zip((s.table for s in SPECS), pool.map(lambda s: self._load(s, read(s, dataset_id), dataset_id), SPECS), strict=True))
                tables = {spec.table: self.table(spec.table, dataset_id) for spec in SPECS}
                checks = validate(tables, {spec.table: spec.prefix for spec in SPECS}, min_rows, {t: o["n"] for t, o in observed.items()})
                repeated = reduce(DataFrame.unionByName, (repeated_keys(tables[s.table], s.key).limit(1).select(F.lit(s.table).alias("t")) for s in SPECS))
                checks["errors"] += [f"{r['t']} repeats keys" for r in repeated.collect()]
                checks["ok"] = not checks["errors"]
                self._update(dataset_id, status="ready" if checks["ok"] else "failed", validation=checks, row_counts={t: o["n"] for t, o in observed.items()}, observed=observed, error_text="; ".join(checks["errors"]) or None)
                if not checks["ok"]:
                    raise ValueError("validation failed: " + "; ".join(checks["errors"]))
                self._index(dataset_id)
                distribution.write({s.table: (self.table(s.table, dataset_id), s.names) for s in SPECS}, f"{self.root}/distribution/dataset_id={dataset_id}")
            except Exception as e:
                self._update(dataset_id, status="failed", error_text=str(e)[:10_000])
                raise
            if activate:
                self._activate(dataset_id)
        return dataset_id

    def _load(self, spec: Spec, rows: DataFrame, dataset_id: int) -> dict:
        """Writes a table of a version and returns what the write itself observed: rows, and nulls, lowest and highest value of each column, as texts."""
        # neighbours in the order of searches, so that a filter on the postal code skips row groups
        order = ["postal_code", spec.key] if spec.table == "address_range" else [spec.key]
        rows = rows.drop("dataset_id")
        if spec.table in _SPREAD:
            # a table may come as one split: its names are made where its rows are dealt to
            rows = rows.drop("name_norm").repartitionByRange(*order)
            rows = rows.withColumn("name_norm", norm_text(F.col(spec.name))) if spec.name else rows
        rows = rows.sortWithinPartitions(*order)
        seen = Observation()
        each = [x for c in spec.names for x in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.min(c).cast("string").alias(f"a_{c}"), F.max(c).cast("string").alias(f"z_{c}"))]
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n"), *each).write
        for key in ("id_street", "id_main_city", "id_city") if spec.table == "address_range" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")  # a search by few ids skips row groups
        writer.parquet(f"{self.root}/{spec.table}/dataset_id={dataset_id}")
        told = seen.get
        return {"n": told["n"], "columns": {c: [told[f"n_{c}"], told[f"a_{c}"], told[f"z_{c}"]] for c in spec.names}}

    def _index(self, dataset_id: int) -> None:
        """Builds the trigram index of the names that are searched."""
        word = ocr_norm_text(F.col("lex_key1"))
        named = {s.table: (self.table(s.table, dataset_id), s.key, F.col("name_norm"), word) for s in SPECS if s.table in ("main_city", "city", "street")}
        name_index.write(name_index.names_of(named), f"{self.root}/name_index/{dataset_id}")

    def table(self, name: str, dataset_id: int) -> DataFrame:
        """A table of one version, by a literal filter that prunes partitions."""
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("dataset_id") == dataset_id)

    def active(self) -> int | None:
        return self._read()["active"]

    def current(self, name: str) -> DataFrame:
        """A table of the active version."""
        dataset_id = self.active()
        if dataset_id is None:
            raise NoActiveDataset("no active dataset")
        return self.table(name, dataset_id)

    def register_views(self) -> None:
        """Temporary views current_<table> of the active version, and active_dataset with its row of the registry; then the SQL functions, the search among them."""
        for spec in SPECS:
            self.current(spec.table).createOrReplaceTempView(f"current_{spec.table}")
        self.registry().where(F.col("dataset_id") == self.active()).createOrReplaceTempView("active_dataset")
        sql.register(self.spark)

    def statistics(self, dataset_id: int) -> DataFrame:
        """(table_name, column_name, n_rows, nulls, low, high) of a version's tables, lowest and highest values as text: what the import observed, without reading a table."""
        observed = next((d for d in self._read()["datasets"] if d["dataset_id"] == dataset_id), {}).get("observed") or {}
        rows = [(table, c, o["n"], *told) for table, o in observed.items() for c, told in o["columns"].items()]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, n_rows long, nulls long, low string, high string")

    def distribution(self, dataset_ids: list[int], parts: int = 10, common: int = 10) -> DataFrame:
        """The distributions of the columns of versions taken together, from the sketches of their imports; see `distribution.distribution`."""
        missing = [i for i in dataset_ids if not (self.root / "distribution" / f"dataset_id={i}").exists()]
        if missing or not dataset_ids:
            raise ValueError(f"no distributions of versions {missing}")
        sketches = self.spark.read.parquet(f"{self.root}/distribution").where(F.col("dataset_id").isin(*dataset_ids))
        return distribution.distribution(sketches, parts, common)

    def gazetteer(self) -> Gazetteer:
        names = ("federal_subject", "district", "main_city", "city", "street", "address_range")
        return Gazetteer(*(self.current(n).drop("dataset_id") for n in names), dataset_id=self.active(), index=self.index(self.active()))

    def index(self, dataset_id: int) -> NameIndex | None:
        """The trigram index of a version's names; versions of older imports have none."""
        path = self.root / "name_index" / str(dataset_id)
        return NameIndex(self.spark, str(path)) if path.exists() else None

    def _activate(self, dataset_id: int) -> None:
        state = self._read()
        chosen = next((d for d in state["datasets"] if d["dataset_id"] == dataset_id), None)
        if chosen is None or chosen["status"] not in KEPT:
            raise ValueError(f"dataset {dataset_id} cannot be activated")
        if state["active"] == dataset_id:
            return
        for d in state["datasets"]:
            if d["status"] == "active":
                d["status"] = "retired"
        chosen |= {"status": "active", "activated_at": datetime.now(UTC).isoformat(), "error_text": None}
        state["active"] = dataset_id
        self._write(state)

    def activate(self, dataset_id: int) -> None:
        """Makes a version the active one, also an older one; what was active is retired."""
        with self._locked():
            self._activate(dataset_id)

    def _delete(self, dataset_id: int) -> None:
        for spec in SPECS:
            shutil.rmtree(self.root / spec.table / f"dataset_id={dataset_id}", ignore_errors=True)
        shutil.rmtree(self.root / "name_index" / str(dataset_id), ignore_errors=True)
        shutil.rmtree(self.root / "distribution" / f"dataset_id={dataset_id}", ignore_errors=True)

    def prune(self, keep: int = 2) -> list[int]:
        """Deletes the versions of `to_prune` and returns their ids."""
        with self._locked():
            gone = sorted(r["dataset_id"] for r in to_prune(self.registry(), keep).collect())
            state = self._read()
            state["datasets"] = [d for d in state["datasets"] if d["dataset_id"] not in gone]
            self._write(state)
            for dataset_id in gone:
                self._delete(dataset_id)
        return gone
