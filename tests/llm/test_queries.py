"""The registered queries without SQL, each over its whole table, against a library or brute force."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
import regex
import sentencepiece

from toponym.llm import decontamination, queries, secret_scan
from toponym.llm import secret_scan as s

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, docs):
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and re.search(r"[^\W\d_]", docs[r["doc_id"]]["text"] or "")]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held) and held


def test_op4(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op4_token_counts(spark, SF).collect()}
    assert got == {i: (len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 4096) for i, r in docs.items()}


def edits(item, text):
    """Fewest edits of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_op9(spark, docs):
    items = {r["item_id"]: decontamination.normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op9_decontamination(spark, SF).collect()}
    texts = {i: decontamination.normalised(r["text"] or "") for i, r in docs.items()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if len(x) >= decontamination.Q and x in t}
    assert whole and whole == {k for k, r in got.items() if r["edits"] == 0}
    for (d, i), r in got.items():
        part = texts[d][max(0, r["start"] - 20) : r["past"] + 20]
        assert r["edits"] == edits(items[i], part) <= len(items[i]) * decontamination.RATE


def own_features(c, before, after, path):
    share = lambda p, x=c: (len(x) - len(re.sub(p, "", x))) / len(x)
    flag = lambda p, x, f=0: float(bool(regex.search(p, x, regex.ASCII | f)))
    words = "|".join(sorted((w for w in s.DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    kinds = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=\-])(?=[^+/_=\-])"
    return [
        float(min(len(c), 100)), share("[0-9]"), share("[A-Z]"), len(re.findall(kinds, c)) / len(c), len(set(c)) / min(len(c), 40), share(words, c.lower()), flag(r"^(?:[0-9a-f]+|[0-9A-F]+)$", c), flag(r"^[0-9\-]+$", c),
        share("[aeiouAEIOU]"), flag(rf"(?:{s.FOR})[A-Za-z_]*[^A-Za-z0-9\n]{{0,8}}$", before, regex.I), flag(rf"(?:{s.FOR})", before, regex.I), flag(rf"(?<![a-z])(?:{s.AGAINST})[^a-z]", before, regex.I), flag("[\"'`]$", before),
        float(bool(re.search("^[@.]", after) or re.search("[@.]$", before))), flag(s.TEST_PATH, path), flag(s.SETTINGS_PATH, path), share(f"[{re.escape(s.SIGNS)}]"), flag(s.KNOWN, c), flag(r"://[^\s:/@]+:$", before),
    ]


def test_op10(spark):
    large = "/root/testdata/sf0.01"  # the smaller tables hold no secret
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{large}/documents.parquet").collect()}
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    cut = regex.compile(s.CANDIDATE, regex.ASCII)

    def vote(tree, x):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    expected = set()
    for i, r in docs.items():
        text = r["text"] or ""
        for number, m in enumerate(cut.finditer(text)):
            x = own_features(m[0], text[max(0, m.start() - s.BEFORE) : m.start()], text[m.end() : m.end() + s.AFTER], r["source"] or "")
            if sum(vote(t, x) for t in forest) / len(forest) >= 0.5:
                expected.add((i, number, len(m[0]), hashlib.sha256(m[0].encode()).hexdigest()))
    got = {(r["doc_id"], r["number"], r["length"], r["secret_sha256"]) for r in queries.op10_secret_scan(spark, large).collect()}
    assert got == expected and expected
