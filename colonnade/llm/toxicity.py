"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A document is toxic if one sentence is: 1 - prod(1 - p) over its sentences. p is
logistic in the sentence's words and their stems (the first four and five
letters), so that unseen endings of a known stem count. Features that labels tie
to toxicity are chosen from a sample; their weights are fitted to the noisy-or
likelihood. LEAK, the logit of a sentence without any, is a constant that training
starts from; scores divide it out of the product, so that such sentences add
nothing, however many a text has.
``sentences`` shows where.

The sample is bounded: at most SAMPLE labelled documents, the first by a hash of
their ids, of at most SAMPLE_BYTES bytes each. Every text is scored whole.

Defined results: a null or empty text scores 0; a feature counts once a sentence;
labels of unknown documents and null labels are ignored, of several labels the
largest holds; without a label of either kind every score is 0; rows are scored
independently. Extra columns are ignored, or pass through ``keep_clean``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.columns import as_text, offsets, ranges, slices, sums, words

SAMPLE, SAMPLE_BYTES = 8_000, 200_000
SENTENCE = r"[.!?\n]+"
LEAST_DOCS, LEAST_ODDS, LEAK = 4, 2.0, -11.0
_ENDS = str.maketrans(".!?", "   ")
_strip = regex.compile(r"^\P{L}+|\P{L}+$").sub


@lru_cache(maxsize=200_000)
def features(word: str) -> tuple[str, ...]:
    w = _strip("", word).lower()
    return (f"={w}", w[:4] + "*", w[:5] + "**")[: max(1, min(3, len(w) - 3))] if w else ()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def fit(texts: list[str], toxic: np.ndarray, steps: int = 300) -> tuple[dict[str, float], float]:
    """Weights of features, and the logit of a sentence without any."""
    n = [int((toxic == 0).sum()), int((toxic == 1).sum())]
    if not min(n):
        return {}, LEAK

    def counted(label: int, among: set[str] | None) -> Counter:
        """In how many texts of a label each feature occurs."""
        seen: Counter = Counter()
        for t, y in zip(texts, toxic):
            if y == label:
                got = {f for w in set((t or "").translate(_ENDS).split()) for f in features(w)}
                seen.update(got if among is None else got & among)
        return seen

    # one text at a time: only features of toxic texts are ever held
    often = Counter({f: k for f, k in counted(1, None).items() if k >= LEAST_DOCS})
    clean = counted(0, set(often))
    odds = lambda f: math.log((often[f] + 0.1) / (n[1] + 0.2)) - math.log((clean[f] + 0.1) / (n[0] + 0.2))
    index = {f: k for k, f in enumerate(sorted(f for f in often if odds(f) >= LEAST_ODDS))}  # sorted: sums of floats depend on the order
    if not index:
        return {}, LEAK
    row, column, doc, empty = [], [], [], np.zeros(len(texts))
    for d, t in enumerate(texts):
        for s in regex.split(SENTENCE, t or ""):
            hit = {index[f] for w in s.split() for f in features(w) if f in index}
            if hit:
                row += [len(doc)] * len(hit)
                column += sorted(hit)
                doc.append(d)
            else:
                empty[d] += 1
    row, column, doc = np.array(row, np.int64), np.array(column, np.int64), np.array(doc, np.int64)
    w, b = np.zeros(len(index)), LEAK
    m, v = np.zeros(len(w)), np.zeros(len(w))
    quiet = empty * math.log1p(-1 / (1 + math.exp(-b)))
    for k in range(1, steps + 1):
        z = b + np.bincount(row, w[column], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.minimum(quiet + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(texts)), -1e-9)
        # d loss / d log(prod(1 - p)): -1 for clean documents, else e^none / (1 - e^none)
        slope = np.where(toxic == 1, np.exp(none) / -np.expm1(none), -1.0)
        grad = np.bincount(column, (slope[doc] * -p)[row], len(w)) / len(texts) * 100 + 0.002 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w = np.maximum(w, 0)
    return {f: float(w[k]) for f, k in index.items() if w[k] > 1e-3}, b


class Model:
    def __init__(self, weights: dict[str, float], leak: float):
        self.weights, self.leak = weights, leak
        self.index = {f: k for k, f in enumerate(weights)}
        self.values = np.fromiter(weights.values(), np.float64, len(weights))
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        """The numbers of a word's features that have a weight."""
        got = self.known.get(w)
        if got is None:
            got = tuple(self.index[f] for f in features.__wrapped__(w) if f in self.index)
            if len(self.known) < 200_000:
                self.known[w] = got
        return got

    def logits(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All sentences, their logits, and each text's offsets. A feature that a sentence repeats counts once, as in training."""
        parts = pc.split_pattern_regex(texts, SENTENCE)
        at = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        sentences = parts.flatten()
        codes, names, bounds = words(sentences)
        of = [self.word(w) for w in names.to_pylist()]
        n = np.fromiter(map(len, of), np.int64, len(of))
        z = np.full(len(sentences), self.leak)
        hit = np.flatnonzero(n[codes] > 0) if len(names) else np.zeros(0, np.int64)
        if len(hit):
            flat, start, code = np.fromiter((k for ks in of for k in ks), np.int64, int(n.sum())), offsets(n)[:-1], codes[hit]
            sentence = np.repeat(np.searchsorted(bounds, hit, "right") - 1, n[code])
            pair = np.unique(sentence * len(self.values) + flat[ranges(start[code], n[code])])
            z += np.bincount(pair // len(self.values), self.values[pair % len(self.values)], len(z))
        return sentences, z, at

    def scores(self, texts: pa.Array) -> np.ndarray:
        _, z, at = self.logits(texts)
        # what each sentence adds beyond the leak: exactly nothing where it has no feature
        none = np.logaddexp(0, self.leak) - np.logaddexp(0, np.clip(z, -30, 30))
        return np.maximum(-np.expm1(sums(none, at)), 0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits labels.toxic on the bounded sample of documents whose id isn't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    got = texts.join(F.broadcast(first), "doc_id").orderBy("doc_id", "text").limit(sample).toPandas()  # at most sample rows of sample_bytes
    return Model(*fit(got["text"].tolist(), got["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            p = model.scores(as_text(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number), score, text of the sentences that offend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            text, z, at = model.logits(as_text(batch.column("text")))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            hit = np.flatnonzero(p >= least)
            row = np.searchsorted(at, hit, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(hit - at[row]), pa.array(p[hit]), text.take(pa.array(hit)).cast(pa.string())], ["doc_id", "sentence", "score", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence long, score double, text string")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score under 0.5, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            yield batch.filter(pa.array(model.scores(as_text(batch.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
