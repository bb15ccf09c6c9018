"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters, lower-cased) has affix, character n-gram and lexicon features; labels of neighbouring words are tied by
learned transitions; forward-backward gives each word's posterior, so words of code-switched texts are labelled one by one. A
document's language has the largest sum of posteriors, and its share is the score.

The model is fitted on the driver from a bounded sample: about PER_LANGUAGE documents of each language, fewer where all would be more than SAMPLE, chosen by
a hash of key and text over the whole table, longer ones than LONGEST characters only where a language has too few others and by their first characters, and of these WORDS words for each language. No label is left out; a column with more than
LABELS different values is no column of languages and raises an error. Sentences of different documents are put in a row to teach
switching. Prediction reads whole texts in tasks, without a shuffle.

Null text or text without a letter: `und` with score 0. A sample without any language gives `und` for all. Ties go to the
language that sorts first. Repeated rows are predicted each by itself. An empty table gives an empty result. Columns to carry along
travel in one struct, so that their names cannot clash.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released, slices, small_batches

PER_LANGUAGE = 150
SAMPLE = 9_600
LABELS = 2_000
LONGEST = 20_000
WORDS = 40_000
#: Features that the model keeps at most, the most frequent ones.
FEATURES = 200_000
#: Words of each language's lexicon.
LEXICON = 300
#: Words of one training sequence, and the chance that a sentence is followed by one of another document.
SEQUENCE = 60
SWITCH = 0.3
STEPS = 60
#: Least value of an exponential, so that no product of a step vanishes.
LEAST = 1e-100
#: Words whose emissions a worker remembers; when there are more it starts afresh.
REMEMBERED = 100_000
UNKNOWN = "und"
NOT_LETTERS = r"\P{L}+"
_SENTENCE = re.compile(r"[.!?\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str, lexicons: dict[str, list[str]]) -> list[str]:
    """Names of a word's features."""
    edged = f"^{word}$"
    out = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    out += [edged[i : i + 2] for i in range(len(edged) - 1)] + [edged[i : i + 3] for i in range(len(edged) - 2)]
    return out + lexicons.get(word, [])


@dataclass
class Crf:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    lexicons: dict[str, list[str]]
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "scores": None}

    def forget(self) -> None:
        """Gives the remembered words back."""
        self.known, self.scores = {}, None

    def flat_features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words, and where each word's begin; number 0 is a feature that every word has."""
        flat, starts = [], []
        get = self.index.get
        for w in words:
            starts.append(len(flat))
            flat.append(0)
            flat += [i for i in map(get, features(w, self.lexicons)) if i is not None]
        return np.array(flat, np.int64), np.array(starts, np.int64)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the labels for each of some distinct words."""
        if self.scores is None or len(self.known) > REMEMBERED:
            self.known, self.scores = {}, np.zeros((0, len(self.labels)), np.float32)
        new = [w for w in words if w not in self.known]
        if new:
            flat, starts = self.flat_features(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, np.add.reduceat(self.weights[flat], starts).astype(np.float32)])
        return self.scores[[self.known[w] for w in words]]


def forward_backward(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words of many sequences, whose words begin at starts; with pairs also the expected transition counts.

    All sequences that still have a word at step t are handled in one operation.
    """
    e = scores.astype(np.float64)  # a copy, changed in place
    if len(e):
        e -= e.max(axis=1, keepdims=True)
        np.maximum(np.exp(e, out=e), LEAST, out=e)
    a = np.maximum(np.exp(transitions - transitions.max()), LEAST)
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    begin, length = starts[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")
    alpha = np.empty_like(e)
    counts = np.zeros_like(a)
    for t in range(longest):
        at = begin[: active[t]] + t
        x = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    beta = np.ones((len(begin), a.shape[0]))
    post = alpha
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        if t + 1 < longest:
            m = active[t + 1]
            after = e[begin[:m] + t + 1] * beta[:m]
            if pairs:
                # the sum of all sequences' pairs at once: no matrix for each
                z = ((alpha[at[:m]] @ a) * after).sum(axis=1)
                counts += a * (alpha[at[:m]].T @ (after / z[:, None]))
            back = after @ a.T
            beta[:m] = back / back.sum(axis=1, keepdims=True)
        x = alpha[at] * beta[:n]
        post[at] = x / x.sum(axis=1, keepdims=True)
    return post, counts


def _sequences(rows: list[tuple[str, str]], seed: int) -> list[list[tuple[str, str]]]:
    """Sequences of (word, language) whose sentences change document now and then."""
    rnd = random.Random(seed)
    sentences = [[(w, lang) for w in _LETTERS.findall(s)] for text, lang in rows for s in _SENTENCE.split(text.lower())]
    sentences = [s for s in sentences if s]
    far = sentences[:]
    rnd.shuffle(far)
    out, now = [], []
    for near, other in zip(sentences, far, strict=True):
        now += other if rnd.random() < SWITCH else near
        while len(now) >= SEQUENCE:
            out.append(now[:SEQUENCE])
            now = now[SEQUENCE:]
    return out + ([now] if now else [])


def fit(rows: list[tuple[str, str]], seed: int = 7, words_per_language: int = WORDS) -> Crf:
    """A model from (text, language) rows by gradient ascent on the likelihood with an L2 penalty; it reads at most words_per_language words for each language."""
    labels = sorted({lang for _, lang in rows})
    sequences = _sequences(rows, seed)
    random.Random(seed).shuffle(sequences)
    limit = max(1, words_per_language * len(labels) // SEQUENCE)
    sequences, beyond = sequences[:limit], sequences[limit:]
    seen_labels = {lang for s in sequences for _, lang in s}
    for s in beyond:  # at most one more for each label that has none yet
        if new := {lang for _, lang in s} - seen_labels:
            sequences.append(s)
            seen_labels |= new
    by_lang: dict[str, Counter] = defaultdict(Counter)
    for s in sequences:
        for w, lang in s:
            by_lang[lang][w] += 1
    lexicons: dict[str, list[str]] = defaultdict(list)
    for lang in labels:
        for w, _ in sorted(by_lang[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons[w].append(f"l:{lang}")
    lexicons = dict(lexicons)
    words = sorted({w for s in sequences for w, _ in s})
    seen = Counter(f for w in words for f in features(w, lexicons))
    chosen = [f for f, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FEATURES] if n > 1]
    k = len(labels)
    model = Crf(labels, {f: i + 1 for i, f in enumerate(chosen)}, np.zeros((len(chosen) + 1, k)), np.zeros((k, k)), lexicons)
    if not sequences or k < 2:
        return model
    number, place = {w: i for i, w in enumerate(words)}, {lang: i for i, lang in enumerate(labels)}
    ids = np.array([number[w] for s in sequences for w, _ in s])
    gold = np.array([place[lang] for s in sequences for _, lang in s])
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    flat, first = model.flat_features(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(flat))))
    inside = np.ones(len(ids), bool)
    inside[starts[:-1]] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    gold_words = np.zeros((len(words), k))
    np.add.at(gold_words, (ids, gold), 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.transitions)]
    for step in range(1, STEPS + 1):
        scores = np.add.reduceat(model.weights[flat], first)
        post, pairs = forward_backward(scores[ids], starts, model.transitions, pairs=True)
        lack = gold_words - np.stack([np.bincount(ids, post[:, j], len(words)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(flat, lack[owner, j], len(model.weights)) for j in range(k)], axis=1)
        for p, g, m in zip((model.weights, model.transitions), (by_feature, gold_pairs - pairs), moments, strict=True):
            g = (g - 0.1 * p) / len(ids)
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    return model


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """The bounded training sample of labelled rows, at most SAMPLE of them but one for each label at least. Runs three jobs.

    Of each label the rows with the smallest hashes are drawn; a text of more than LONGEST characters is drawn only where its label has too few shorter ones, and counts with its first LONGEST characters. That is for training; predictions read whole texts.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    sizes = usable.groupBy(F.col(lang).alias("lang")).count().limit(LABELS + 1).collect()
    if len(sizes) > LABELS:
        raise ValueError(f"{lang} has more than {LABELS} values")
    if not sizes:
        return []
    wanted = max(1, min(per_language, SAMPLE // len(sizes)))
    # the length and a hash of key and text in one number: short ones come first
    order = F.when(F.length(text) > LONGEST, F.lit(1 << 62)).otherwise(F.lit(0)) + F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.col(text)), 2)
    keyed = usable.select(F.col(lang).alias("lang"), order.alias("order"), F.substring(text, 1, LONGEST).alias("text"))
    first = keyed.select("lang", "order").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("n") <= wanted)
    cuts = {r["lang"]: r["cut"] for r in first.groupBy("lang").agg(F.max("order").alias("cut")).collect()}  # a row for each label
    cut = F.element_at(F.from_json(F.lit(json.dumps(cuts)), "map<string,bigint>"), F.col("lang"))
    # rows that repeat key and text are one
    rows = keyed.where(F.col("order") <= cut).dropDuplicates(["lang", "order"]).orderBy("order", "lang").limit(wanted * len(cuts)).collect()
    return [(r["text"], r["lang"]) for r in rows]


def predict(docs: DataFrame, model: Crf, text: str = "text", carry: list[str] | None = None, segments: bool = False) -> DataFrame:
    """The carried columns (all, if None), lang_pred, score, and with segments the runs of words of one language: array<struct<lang,first,words>>."""

    small_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    # the text travels once, whether it is carried or not
    rows = docs.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names) if c != text)).alias("row"), F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features
    kind = rows.schema["row"].dataType
    out_schema = f"row {kind.simpleString()}, text string, lang_pred string, score double, segments array<struct<lang:string,first:int,words:int>>"
    fields = ["row", "text", "lang_pred", "score", "segments"]
    segment_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in slices(batches, "text"):
            lower = pc.utf8_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            lists = pc.split_pattern_regex(lower, NOT_LETTERS)
            flat = lists.flatten()
            full = pc.not_equal(pc.binary_length(flat), 0)
            seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
            starts = seen[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            coded = pc.dictionary_encode(flat.filter(full))
            n = batch.num_rows
            if not len(coded) or not crf.labels:
                nothing = pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([[]] * n if segments else [None] * n, segment_type)
                yield pa.record_batch([batch.column("row"), batch.column("text") if text in names else pa.nulls(n, pa.string()), *nothing], names=fields)
                continue
            scores = crf.emissions(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            post, _ = forward_backward(scores, starts, crf.transitions)
            words = np.diff(starts)
            total = np.zeros((n, post.shape[1]))
            total[words > 0] = np.add.reduceat(post, starts[:-1][words > 0])
            best = total.argmax(axis=1)
            share = np.where(words > 0, total[np.arange(n), best] / np.maximum(words, 1), 0.0).clip(0, 1).round(9)
            langs = [crf.labels[b] if w else UNKNOWN for b, w in zip(best.tolist(), words.tolist(), strict=True)]
            parts = [_runs(post[a:b].argmax(axis=1), crf.labels) for a, b in zip(starts[:-1], starts[1:], strict=True)] if segments else [None] * n
            yield pa.record_batch([batch.column("row"), batch.column("text") if text in names else pa.nulls(n, pa.string()), pa.array(langs), pa.array(share), pa.array(parts, segment_type)], names=fields)
        crf.forget()

    out = rows.mapInArrow(released(run), out_schema)
    own = [F.col("text" if c == text else f"row.c{n}").alias(c) for n, c in enumerate(names)]
    return out.select(*own, "lang_pred", "score", *(["segments"] if segments else []))


def _runs(labels: np.ndarray, names: list[str]) -> list[dict]:
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)] if len(labels) else []
    return [{"lang": names[labels[a]], "first": a, "words": b - a} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
