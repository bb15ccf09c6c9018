import random

import pyarrow as pa

from toponym.operators import candidates

SCORES = ("score", "house_score", "street_score", "city_score")


def test_best_of_task_is_the_ranking(monkeypatch):
    """Rows of a task are cut to the best of each query without being held whole."""
    monkeypatch.setattr(candidates, "GATHERED", 30)
    rnd = random.Random(3)
    rows = [{"query_id": rnd.choice([3, 1, None, 9]), "id_address": i, "postal_code": str(i)} | {c: rnd.choice([0.0, 0.5, 1.0] + [None] * (c != "score")) for c in SCORES} for i in rnd.sample(range(10_000), 1000)]
    schema = pa.schema([("query_id", pa.int64()), ("id_address", pa.int64()), ("postal_code", pa.string()), *((c, pa.float32()) for c in SCORES)])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 17], schema) for i in range(0, 1000, 17)] + [pa.RecordBatch.from_pylist([], schema)]
    got = [r for b in candidates._best_of_task(5)(iter(batches)) for r in b.to_pylist()]
    for q in (1, 3, 9, None):
        best = sorted((r for r in rows if r["query_id"] == q), key=candidates._rank)[:5]
        assert [r for r in got if r["query_id"] == q] == best
    assert len(got) == 20 and list(candidates._best_of_task(5)(iter(batches[-1:]))) == []
