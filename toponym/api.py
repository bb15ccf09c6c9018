"""Requests for address candidates as plain functions: validation, and the answer as a dictionary."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.errors import PySparkException

from .operators.candidates import Gazetteer, InvalidQuery, NoActiveDataset, find_address_candidates
from .sources.store import Store


@dataclass(frozen=True)
class CandidateRequest:
    """A request; what is wrong with it raises ValueError."""

    postal_code: str | None = None
    city: str | None = None
    street: str | None = None
    house: str | None = None
    limit: int = 20

    def __post_init__(self) -> None:
        if self.postal_code is not None and not re.fullmatch(r"\d{6}", self.postal_code, re.A):
            raise ValueError("postal_code has to be 6 digits")
        for name, most in (("city", 256), ("street", 256), ("house", 64)):
            if len(getattr(self, name) or "") > most:
                raise ValueError(f"{name} has more than {most} characters")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit has to be from 1 to 100")
        if not any((x or "").strip() for x in (self.postal_code, self.city, self.street)):
            raise ValueError("postal_code, city or street is needed")


def _ms(began: float) -> float:
    return round((time.perf_counter() - began) * 1000, 3)


def candidates(g: Gazetteer, request: CandidateRequest) -> dict:
    """Status, echo of the query, count, milliseconds of the search and of all, and rows; 503 where the search refuses or fails."""
    began = time.perf_counter()
    try:
        found = find_address_candidates(g, request.postal_code, request.city, request.street, request.house, request.limit)
        searched = time.perf_counter()
        rows = [r.asDict() for r in found.collect()]
        db_ms = _ms(searched)
    except (InvalidQuery, NoActiveDataset, PySparkException) as e:
        return {"status": 503, "detail": str(e)}
    return {"status": 200, "query": request.__dict__, "count": len(rows), "timing": {"db_ms": db_ms, "total_ms": _ms(began)}, "candidates": rows}


def health(store: Store) -> dict:
    """The active version, or 503 without one, without the search function of its views, or where the store cannot be read."""
    try:
        chosen = next((d for d in store.datasets() if d["dataset_id"] == store.active()), None)
        ready = store.spark.catalog.functionExists("find_address_candidates")
    except (OSError, ValueError, PySparkException) as e:
        return {"status": 503, "detail": str(e)}
    if chosen is None:
        return {"status": 503, "detail": "no active dataset"}
    if not ready:
        return {"status": 503, "detail": "the views and functions are not registered"}
    return {"status": 200, "active_dataset": {k: chosen.get(k) for k in ("dataset_id", "source_filename", "status", "imported_at", "activated_at")}}
