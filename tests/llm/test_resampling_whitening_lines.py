"""Importance resampling, whitening and line dedup against brute force, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from toponym.llm import importance_resampling as ir
from toponym.llm import line_dedup as ld
from toponym.llm import queries
from toponym.llm import whitening as w

SF = "/root/testdata/sf0.001"

# Importance resampling ---------------------------------------------------------------------------------------------------------


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words)]


def resampled(docs, target, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    held = [(i, t, *runs(t, s.longest)) for i, t in docs]
    own, other = Counter(bucket(f) for _, _, _, fs in held for f in fs), Counter(bucket(f) for t in target for f in runs(t, s.longest)[1])
    total, wanted = sum(own.values()), sum(other.values())
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (total + s.buckets) / ((own[b] + 1) * (wanted + s.buckets)))) for b in own}
    rows = []
    for i, _, words, fs in held:
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    long = sorted((r for r in rows if r[4] >= s.least_words), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    drawn = Counter((r[:4], n) for n, r in enumerate(long[: len(long) * s.percent // 100], 1))
    return rows, drawn


ODD = [(None, "One two THREE four"), (1, None), (2, ""), (3, " .,- "), (4, "Élan ÉLAN élan x x x"), (5, "a" * 300 + " b " * 50), (6, "same text here and more"), (6, "same text here and more"), (6, "other text"), (7, "x," * 200), (8, "two two two two two two")]


@pytest.mark.parametrize("sampling", [ir.Sampling(percent=50, least_words=3), ir.Sampling(longest=3, buckets=50, percent=100, least_words=2, seed="x")])
def test_resample(spark, monkeypatch, sampling):
    monkeypatch.setattr(ir, "PART", 64)  # texts are cut into many parts
    target = ["two x more", None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, bucket int").repartition(3)
    got = ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), sampling).collect()
    rows, drawn = resampled(ODD, target, sampling)
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in rows)
    assert Counter((tuple(r)[:4], r["rank"]) for r in got if r["rank"]) == drawn and drawn
    nothing = ir.resample(docs.where("false"), docs.where("false"), sampling)
    assert nothing.isEmpty() and ir.resample(docs, docs.where("false"), sampling).count() == len(ODD)


# Whitening ---------------------------------------------------------------------------------------------------------------------


def whitened(vectors, k):
    x = np.floor(256 * np.array(vectors, float)).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    values, e = np.linalg.eigh((u - s / n).T @ (u - s / n) / n)
    values, e = values[::-1][:k], e[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ e / np.sqrt(values), values / ((u - s / n) ** 2).sum() * n


def same(got, ids, vectors, k):
    n, deviation, z, share = whitened(vectors, k)
    found = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(ids) * k
    for c in range(k):
        own = np.array([found[i, c + 1]["whitened"] for i in ids])
        assert np.abs(own * np.sign(own @ z[:, c]) - z[:, c]).max() < 1e-9
        assert all(abs(found[i, c + 1]["explained"] - share[c]) < 1e-12 for i in ids)
    assert all(found[i, 1]["deviation"] == d and found[i, 1]["n"] == n and found[i, 1]["identity_error"] < 1e-9 for i, d in zip(ids, deviation.tolist(), strict=True))


def test_whitening_of_the_table(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    same(queries.op12_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 4)


def test_whitening_of_odd_rows(spark):
    random = np.random.default_rng(1)
    vectors = (random.standard_normal((40, 6)) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32).tolist()
    rows = [(i, v, 7) for i, v in enumerate(vectors)] + [(100 + i, vectors[0], 7) for i in range(200)]  # one vector in five of six rows
    odd = [(900, None, 7), (901, [], 7), (902, [None] * 6, 7), (903, [float("nan")] * 6, 7), (904, [float("-inf")] * 6, 7), (905, [1.0, 2.0], 7)]
    table = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>, x int").repartition(5)
    same(w.whiten(table(rows + odd), 3).collect(), [r[0] for r in rows], [r[1] for r in rows], 3)
    assert w.whiten(table(rows[:1] + rows[40:]), 3).isEmpty() and w.whiten(table([]), 3).isEmpty()
    flat = w.whiten(table([(i, [float(i), 1.0, 2.0 * i], 0) for i in range(9)]), 3).collect()  # one direction varies
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    far = w.whiten(table([(i, [1e15 * i, 1e18 * (i % 2)], 0) for i in range(9)]), 2).collect()
    assert all(r["deviation"] is None for r in far) and max(r["identity_error"] for r in far) < 1e-9


@pytest.mark.parametrize("rank", [1, 5, 30])
def test_lanczos(rank):
    random = np.random.default_rng(rank)
    a = random.standard_normal((30, rank))
    a = a @ a.T
    values, vectors, _ = w.block_lanczos(lambda b: a @ b, 30, 4, 8)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:4], atol=1e-12 * np.linalg.norm(a))
    assert np.linalg.norm(a @ vectors - vectors * values) < 1e-12 * np.linalg.norm(a) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_lanczos_stops_before_the_basis_is_full():
    a = np.diag(1.0 / np.arange(1, 401) ** 2)
    values, _, passes = w.block_lanczos(lambda b: a @ b, 400, 4, 8)
    assert np.allclose(values, np.diag(a)[:4], atol=1e-13) and passes < 20


# Line dedup --------------------------------------------------------------------------------------------------------------------


def dropped(rows, rule):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(ld.BLANKS))
    ident = lambda i: -(1 << 63) if i is None else i
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= rule.characters:
                held.setdefault(key(line), set()).add(ident(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(ids := held.get(key(x), ())) < rule.documents or max(ids) == ident(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


LONG, OTHER, WIDE = "This is a line that many documents hold", "Another line that is long enough", "ÉÉ ёё " * 5
LINES = [
    (1, f"{LONG}\nown line of document one, long\n{OTHER}"), (2, f"  \t{LONG.upper()}\r\n{LONG}\n{WIDE}"), (3, f"{OTHER}\n\n{LONG}\n"), (4, None), (5, ""), (6, f"{WIDE}\n{WIDE}"), (None, f"{LONG}\n{WIDE}\n short "),
    (7, f"{OTHER}\n{OTHER}\nthe end of seven, which is long"), (8, "x" * 19 + "\n" + "y" * 20), (9, "x" * 19 + "\n" + "y" * 20), (10, "x" * 19 + "\n" + "y" * 20), (10, "y" * 20), (10, "y" * 20), (11, "\xa0" + "y" * 20), (12, "\n" * 5),
]


@pytest.mark.parametrize(("most", "rule"), [(ld.MOST, ld.Rule()), (2, ld.Rule()), (0, ld.Rule()), (1, ld.Rule(5, 2))])
def test_lines(spark, monkeypatch, most, rule):
    monkeypatch.setattr(ld, "HELD", 1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in LINES], "doc_id long, text string, gone int").repartition(4)
    got = ld.remove_lines(docs, rule, most=most, whole=True)
    assert sorted(map(tuple, got.collect()), key=repr) == dropped(LINES, rule)
    assert ld.remove_lines(docs.where("false"), rule, most=most).isEmpty()


def test_lines_of_a_full_filter_and_a_long_text(spark):
    rows = [(i, "\n".join(f"line {k} of some documents, long" for k in range(i % 7, 4000, 7 + i % 3))) for i in range(40)] + [(99, "z" * 3_000_000 + "\n" + "w" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, ld.remove_lines(docs, ld.Rule(bits=ld.BLOCK), whole=True).collect()), key=repr) == dropped(rows, ld.Rule())  # everything is suspected
