"""What a worker holds at once: batches, slices and arrays of the operators, in bytes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from toponym.llm import byte_bpe, common, decontamination, language_id


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_batches_are_cut_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        common.small_batches(spark)
        rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("ab c"), 25_000).alias("text"))  # 30 MB

        def sizes(batches):
            for b in batches:
                yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

        found = rows.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in found) == 300 and max(r["bytes"] for r in found) < 4 << 20
        spark.conf.set(name, "1m")  # less was asked for
        common.small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_a_slice_of_decontamination_is_small():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    items = decontamination.Items(list(range(50)), [text(30) for _ in range(50)], decontamination.RATE)
    texts = [text(330) for _ in range(2500)]  # 5 MB
    texts[7] += " " + items.texts[3]
    batches = [pa.record_batch([pa.array(texts[i : i + 500])], names=["text"]) for i in range(0, 2500, 500)]
    found = []

    def work():
        for s in common.slices(iter(batches), "text", decontamination.SLICE):
            found.extend(decontamination.find(s.column("text").to_pylist(), items))

    assert peak(work) < 60 << 20
    assert [m[0] for m in found[7]] == [3] and sum(map(bool, found)) == 1


def test_posteriors_hold_few_arrays():
    rnd = np.random.default_rng(2)
    scores, starts, ties = rnd.normal(size=(200_000, 8)).astype(np.float32), np.arange(0, 200_001, 50), rnd.normal(size=(8, 8))
    once = 200_000 * 8 * 8
    before, out = scores.copy(), []
    assert peak(lambda: out.append(language_id.forward_backward(scores, starts, ties)[0])) < 2.9 * once
    assert (scores == before).all() and np.allclose(out[0].sum(axis=1), 1)


def test_chunks_of_byte_bpe_are_split_slice_by_slice(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 3)  # noqa: N815

    monkeypatch.setattr(byte_bpe, "TaskContext", Task)
    rnd = random.Random(6)
    common_words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join([*rnd.choices(common_words, k=490), *(str(rnd.random()) for _ in range(10))]) for _ in range(4000)]  # 12 MB
    texts[5], texts[6] = "", "a  b\tc "
    batches = [pa.record_batch([pa.array(range(i, i + 500)), pa.array(texts[i : i + 500])], names=["key", "text"]) for i in range(0, 4000, 500)]
    rows = []

    def work():
        for b in byte_bpe._split(public_tokenizers.PATTERN, True, 32 << 20, 7, pa.int64())(iter(batches)):
            rows.extend(b.to_pylist())

    assert peak(work) < 24 << 20
    words = {}
    for r in rows:
        if not r["kind"]:
            words |= dict(zip(byte_bpe._unpacked(r["a"], np.int32).tolist(), byte_bpe._words_of(r["b"]), strict=True))
    got = {}
    for r in rows:
        if r["kind"]:
            places, sizes = byte_bpe._unpacked(r["b"], np.int32).tolist(), byte_bpe._unpacked(r["a"], np.int64).tolist()
            assert len(places) < 500_000
            for key, n in zip(r["keys"], sizes, strict=True):
                got[key], places = b"".join(words[x] for x in places[:n]), places[n:]
    assert {r["chunk"] for r in rows} == {3 << 32} and len(set(words.values())) == len(words)
    assert got == {i: t.encode() for i, t in enumerate(texts)}


def test_plans_of_byte_bpe_do_not_hold_the_ranks(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = byte_bpe.encode(spark.createDataFrame([(1, "plans are short")], "doc_id long, text string"), ranks, public_tokenizers.PATTERN, whole=True)
    assert out.first()["decoded"] == b"plans are short"
    assert len(out._jdf.queryExecution().toString()) < 200_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "AS ranks#" not in plan  # no row carries the table
