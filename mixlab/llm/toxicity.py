"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences and only documents are labelled. A sentence's score is a logistic function
of its words' features (the word and its beginnings of 3 to 5 letters, hashed); a document's is the noisy-or
of its sentences: 1 - prod(1 - p). Training follows the gradient of the document's log-likelihood down
to the sentences, so offending sentences are found without a label of their own. Training takes a bounded
sample of labelled documents; scoring takes every whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.llm.common import prepare

#: Bounds of the training sample: documents, and characters of one of them.
TRAIN_DOCS = 5_000
TRAIN_CHARS = 40_000
#: Hashed features; the weights take 4 MB.
BITS = 20
#: Documents of the sample that have a feature, for it to be learned.
MIN_DOCS = 3
THRESHOLD = 0.3
CACHED_WORDS = 300_000

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    parts = [word, *("^" + word[:n] for n in (3, 4, 5) if len(word) >= n)]
    return [xxhash.xxh32_intdigest(p.encode("utf-8")) & ((1 << BITS) - 1) for p in parts]


def sentences(text: str | None) -> list[str]:
    return SENTENCE.findall(text or "")


_scorers: dict[bytes, Scorer] = {}


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        """The scorer of this worker process for this model."""
        key = xxhash.xxh3_128_digest(self.weights.tobytes())
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(self)
        return _scorers[key]


class Scorer(dict):
    """Weight of each word, remembered while there is room."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights, self.bias = memoryview(model.weights), model.bias

    def __missing__(self, word: str) -> float:
        weights = self.weights
        value = sum([weights[f] for f in features(word)])
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value

    def sentence_scores(self, text: str | None) -> np.ndarray:
        z = np.array([sum(map(self.__getitem__, set(WORD.findall(s)))) for s in sentences((text or "").lower())])
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences; a text without sentences scores 0."""
        return float(-np.expm1(np.log1p(-np.minimum(self.sentence_scores(text), 1 - 1e-12)).sum()))


def fit(texts: list[str | None], toxic: list[int], rounds: int = 120, rate: float = 5.0, decay: float = 1e-4, min_docs: int = MIN_DOCS) -> Model:
    """Gradient descent with momentum on the noisy-or likelihood, over features of ``min_docs`` documents or more.

    Without both classes every text scores the constant of the one class.
    """
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 30.0 if len(y) and y.min() else -30.0)
    vocabulary: dict[str, int] = {}
    words, sentence_of, doc_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in sentences((text or "").lower()):
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in set(WORD.findall(s))]
            words.extend(own)
            sentence_of.extend([len(doc_of)] * len(own))
            doc_of.append(d)
    words, sentence_of, doc_of = (np.frombuffer(x, dtype=np.intc) if x else np.zeros(0, np.intc) for x in (words, sentence_of, doc_of))
    if not len(words):
        return Model(np.zeros(1 << BITS, np.float32), -30.0)
    of_word, feature = _common_features(vocabulary, words, doc_of[sentence_of], len(y), min_docs)
    w, b, step, step_b = np.zeros(1 << BITS), -6.0, np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        of_words = np.bincount(of_word, w[feature], len(vocabulary))
        z = np.bincount(sentence_of, of_words[words], len(doc_of)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))  # chance that no sentence offends
        share = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)  # of the gradient, per document
        g = share[doc_of] * p / len(y)
        gradient = np.bincount(feature, np.bincount(words, g[sentence_of], len(vocabulary))[of_word], 1 << BITS) + decay * w
        step, step_b = 0.9 * step + gradient, 0.9 * step_b + g.sum()
        w -= rate * step
        b -= rate * step_b
    return Model(w.astype(np.float32), float(b))


def _common_features(vocabulary: dict[str, int], words: np.ndarray, docs: np.ndarray, n_docs: int, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of the features that ``min_docs`` documents or more have."""
    lists = [features(w) for w in vocabulary]
    count = np.array([len(x) for x in lists], dtype=np.int64)
    feature = np.array([f for x in lists for f in x], dtype=np.intc)
    del lists
    first = np.cumsum(count) - count
    seen = np.unique(docs.astype(np.int64) * len(vocabulary) + words)
    held = np.zeros(1 << BITS, dtype=np.int64)
    for at in range(0, n_docs, 500):  # some documents at a time
        lo, hi = np.searchsorted(seen, [at * len(vocabulary), (at + 500) * len(vocabulary)])
        doc, word = np.divmod(seen[lo:hi], len(vocabulary))
        spread = np.repeat(np.arange(len(word)), count[word])
        place = first[word[spread]] + np.arange(len(spread)) - np.repeat(np.cumsum(count[word]) - count[word], count[word])
        held += np.bincount(np.unique(doc[spread] << BITS | feature[place]) & ((1 << BITS) - 1), minlength=1 << BITS)
    of_word = np.repeat(np.arange(len(count), dtype=np.intc), count)
    common = held[feature] >= min_docs
    return of_word[common], feature[common]


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` labelled documents that are not held out, chosen by hash of the id.

    Documents above ``TRAIN_CHARS`` characters are scored but not learned from. Null labels are left out; an id
    that is labelled more than once is toxic if any label says so.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") <= TRAIN_CHARS)
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    table = rows.toArrow().sort_by("_id")
    return fit(table.column("_text").to_pylist(), table.column("_toxic").to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id and score of every row; with ``spans`` also the sentences above the threshold (place, text, score).

    Null and empty texts score 0. Repeated rows get a row each. The broadcast weights have a fixed size.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "doc_id long, score double" + (", offending array<struct<place:int, text:string, score:double>>" if spans else "")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([scorer.score(t) for t in texts], pa.float64())]
            if spans:
                bad = [[{"place": k, "text": s, "score": float(p)} for k, (s, p) in enumerate(zip(sentences(t), scorer.sentence_scores(t))) if p >= THRESHOLD] for t in texts]
                columns.append(pa.array(bad, pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", *["offending"][: len(columns) - 2]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, kind)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns; decided by the text alone."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
