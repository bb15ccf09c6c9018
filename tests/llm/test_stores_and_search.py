"""Web archives, exact top-k search and the pipeline against brute force."""

import gzip
import hashlib
import math

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from toponym.llm import bit_sliced, byte_bpe, decontamination, secret_scan, warc
from toponym.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def test_archives_round_trip(spark):
    warc.register(spark)
    long, longer = "é" * 700, "x" * 9000
    rows = [(1, "http://a/1", long), (5, "http://a/5", long), (3, None, long), (2, "u\r\nx", "short"), (4, "u", "short"), (6, "u", None), (7, "", longer), (8, "u", longer), (8, "u", longer), (None, "n", longer), (9, "u", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = shared_dir(spark)
    warc.page_records(pages).write.format("warc").mode("append").save(path)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, path).collect()), key=repr)
    keeper = {long: 5, longer: 8}
    expected = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = keeper.get(html) if keeper.get(html) != page else None
        expected.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(expected, key=repr)
    whole = spark.read.format("warc").load(path)
    assert {bytes(r["payload"]).decode() for r in whole.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    some = whole.where("target_uri like 'http://a/%' and record_type in ('response', 'revisit')")
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:x-page:1", "urn:x-page:5"]
    heads = spark.read.format("warc").option("payload", "false").load(path).collect()
    assert len(heads) == len(rows) and all(r["payload"] is None for r in heads)
    empty = shared_dir(spark)
    warc.page_records(pages.limit(0)).write.format("warc").mode("append").save(empty)
    assert warc.read_pages(spark, empty).isEmpty()


def test_archives_are_appended_and_overwritten(spark):
    warc.register(spark)
    path = shared_dir(spark)
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(6)], "page_id long, url string, html string")

    def write(rows, mode):
        warc.page_records(rows).write.format("warc").mode(mode).save(path)
        return sorted(r["page_id"] for r in warc.read_pages(spark, path).collect())

    assert write(pages.where("page_id < 2"), "append") == [0, 1]
    assert write(pages.where("page_id between 2 and 3"), "append") == [0, 1, 2, 3]
    assert write(pages.limit(0), "append") == [0, 1, 2, 3]
    assert write(pages.where("page_id > 3"), "overwrite") == [4, 5]
    assert write(pages.where("page_id = 1"), "append") == [1, 4, 5]


def test_archives_of_other_programs(spark, tmp_path):
    warc.register(spark)
    records = [warc.record("response", f"urn:{i}", "http://x", None, hashlib.sha1(bytes([i]) * n).hexdigest(), n, bytes([i]) * n) for i, n in enumerate((0, 10, 20_000))]
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(b"".join([other, *records]))
    (tmp_path / "zipped.warc.gz").write_bytes(b"".join(map(gzip.compress, [*records, other])))
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted((r["record_type"], len(r["payload"])) for r in rows) == sorted(2 * [("response", 0), ("response", 10), ("response", 20_000), ("warcinfo", 3)])
    assert spark.read.format("warc").load(str(tmp_path)).where("record_type = 'warcinfo'").count() == 2


def test_archives_with_foreign_digests_and_heads(spark, tmp_path):
    warc.register(spark)
    hexed, head = hashlib.sha1(b"x").hexdigest(), "Content-Type: application/http;msgtype=response"

    def member(name, digest, block):
        lines = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:{name}>", *([f"WARC-Payload-Digest: {digest}"] if digest else []), head, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    ok = b"HTTP/1.1 200 OK\r\n\r\nx"
    records = [member("a", "sha1:" + hexed.upper(), ok), member("b", "md5:9dd4e461268c8034f5c8564e155c67a6", ok), member("c", "sha256:AB", ok), member("d", None, b"HTTP/1.1 200 OK"), member("e", None, b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    for payload in ("true", "false"):
        rows = {r["record_id"]: r for r in spark.read.format("warc").option("payload", payload).load(str(tmp_path)).collect()}
        assert [rows[f"urn:{n}"]["payload_digest"] for n in "abcde"] == [hexed, "md5:9dd4e461268c8034f5c8564e155c67a6", "sha256:AB", None, None]
        assert [rows[f"urn:{n}"]["payload_bytes"] for n in "abcde"] == [1, 1, 1, 0, 0]


def nearest(rows, every, k):
    """Every row is a candidate; queries of one id are one query."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    q = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in ok]
    pairs = {}
    for i, a in q:
        if i % every == 0:
            pairs.setdefault(i, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in q if j != i and len(a) == len(b))
    return sorted((i, n, j, -s) for i, found in pairs.items() for n, (s, j) in enumerate(sorted(found)[:k], 1))


def test_top_k(spark, monkeypatch):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").limit(300).collect()]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, []), (2002, [None] * 64), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (None, rows[0][1]), (2006, [1.0, 2.0]), (2007, [-1.0, 0.5]), (2008, [0.0, 0.0]), rows[0], rows[0]]
    near = list(rows[5][1])
    near[0] += 0.01
    rows += [(rows[5][0], near), *[rows[5]] * 8]  # rows that repeat an id, with equal and other vectors
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, block int")
    for block, queries in ((16_384, 128), (64, 5)):
        monkeypatch.setattr(bit_sliced, "BLOCK", block)
        monkeypatch.setattr(bit_sliced, "QUERIES", queries)
        got = bit_sliced.top_k(df, F.col("vec_id") % 8 == 0, 5).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == nearest(rows, 8, 5)
    assert bit_sliced.top_k(df.limit(0), F.col("vec_id") % 8 == 0).isEmpty()
    assert sorted(tuple(r)[:3] for r in bit_sliced.top_k(df.where("vec_id in (2006, 2008)"), F.col("vec_id") > 0).collect()) == [(2006, 1, 2008), (2008, 1, 2006)]


def test_top_k_of_far_components(spark):
    draw = np.random.default_rng(5).uniform(-2e6, 2e6, (50, 64))
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(draw)]
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    every = [sorted(((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q))[:5] for q in range(0, 50, 10)]
    got = bit_sliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, q int"), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(10 * n, i, -s) for n, best in enumerate(every) for s, i in best]


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(50, [1.0]), (1, [0.5]), (1, [0.5]), (1, [0.25]), (2, [0.125])], "vec_id long, embedding array<float>")
    got = bit_sliced.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 256 * 128), (50, 2, 1, 256 * 128), (50, 3, 1, 256 * 64), (50, 4, 2, 256 * 32)]


def test_pipeline(spark):
    """Each stage on its own input, against what it has to keep and change."""
    from test_text_operators import components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None), (9002, "12 34 --"), (9003, ""), (9004, "Quite short")]
    now = docs.unionByName(spark.createDataFrame([(i, t, None, None, 0) for i, t in extra], docs.schema))
    benchmark = [decontamination.normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        path = shared_dir(spark)
        stage(spark, now, SF).write.parquet(path)
        out = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in out.collect()}
        gone = set(before) - set(after)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        if name == "language_id":
            assert gone == {9001, 9002, 9003}
        elif name == "near_duplicates":
            assert gone == {int(i) for i, _, c in components([(i, r["text"]) for i, r in before.items()], 5, 80) if i != c} and gone
        elif name == "decontamination":
            assert gone == {i for i, r in before.items() if any(b in decontamination.normalised(r["text"]) for b in benchmark)} and gone
        elif name == "secrets":
            hit = {r["doc_id"] for r in secret_scan.findings(now, forest).collect()}
            assert not gone and {i for i, r in after.items() if r["text"] != before[i]["text"]} == hit and all(len(r["text"]) == r["n_chars"] for i, r in after.items() if i in hit)
        else:
            assert not gone and all(list(r["ids"]) == library.encode_ordinary(before[i]["text"]) for i, r in after.items())
        now = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(after) - {9004}


CLASHING = ("doc", "key", "row", "may", "again", "matches", "found", "comp", "c0", "n_shingles", "score", "lang_pred")


def test_pipeline_on_odd_tables(spark):
    """Null ids, repeated rows, clashing columns, no labels, empty tables: each stage keeps its columns and does what its docstring says."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words[k : k + 40]) for k in (0, 10, 20))
    near = " ".join([*words[10:49], "other"])
    texts = [(1, a), (1, a), (1, b + " x y z"), (2, b + " x y zz"), (None, c[::-1]), (5, c[::-1]), (6, None), (6, ""), (7, None), (8, near[::-1]), (9, "short"), (10, "short")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in CLASHING)
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), *CLASHING) for i, t in texts], schema)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.isEmpty() and empty.columns == out.columns
        if name != "byte_bpe":
            assert out.columns == docs.columns and all(tuple(r)[5:] == CLASHING for r in out.collect())
        else:
            assert out.count() == len(texts)
    left = sorted(((r["doc_id"] or 0, r["text"] or "") for r in stages["near_duplicates"](spark, docs, SF).collect()))
    assert left == sorted([(1, a), (1, b + " x y z"), (0, c[::-1]), (6, ""), (6, ""), (7, ""), (8, near[::-1]), (9, "short")])
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] or 0 for r in stages["language_id"](spark, unlabelled, SF).collect()) == [0, 1, 1, 1, 2, 5, 8, 9, 10]


def test_bitmap_filter(spark):
    from toponym.llm import filters

    rows, keys = spark.range(5000).withColumn("x", F.lit("y")), spark.range(0, 9000, 7)
    assert filters.semi_join(rows, keys, "id").count() == 715 and filters.anti_join(rows, keys, "id").count() == 4285
    null = rows.select(F.lit(None).cast("long").alias("id")).limit(3)
    assert filters.semi_join(null, keys, "id").count() == 0 and filters.anti_join(null, keys, "id").count() == 3 and filters.anti_join(rows, keys.limit(0), "id").count() == 5000
