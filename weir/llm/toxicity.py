"""Toxicity by multiple-instance learning (op 5).

Labels belong to documents, insults to sentences. A sentence's score is a
logistic model over its words; a document's is the noisy-or of its sentences,
1 - prod(1 - p). The weights are fitted to document labels alone, so the model
learns which sentences bear the label, and ``offending_sentences`` shows them.

Fitting reads a bounded sample: the ``max_rows`` labelled rows with the least
hash of doc_id. Words that stand in its toxic texts more often than chance
explains become features (as hashes): each is tested on its own counts, so a
language with few toxic texts keeps its words. Scores read every text whole.

Edge cases: null and empty texts have no sentence and score 0; labels that are
null, or of documents that don't exist, teach nothing; a doc_id that repeats
in the labels counts as often; without a toxic label every score is 0; a null
doc_id is never held out and is scored; repeated rows each get a row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import LONG_WORD, WORD_CACHE, cut, docs_view, drop, list_column, read

SENTENCE = re.compile(rb"[.!?\n]+")
#: Bytes of ASCII letters and of non-ASCII characters; all others separate words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Rows read for fitting; the signed root of a feature's likelihood ratio against the toxic share of all texts (4.5: by chance 3 words in a million), and its least log odds.
MAX_ROWS, MIN_Z, MIN_ODDS = 20_000, 4.5, 0.7


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sentences(text: bytes | None) -> list[list[bytes]]:
    if not text:
        return []
    return [w for s in SENTENCE.split(text.lower()) if (w := s.translate(LETTERS).split())]


def feature(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


class Model:
    """Word weights by feature, and the intercept; None scores 0 everywhere."""

    def __init__(self, weights: dict[int, float], intercept: float | None):
        self.weights, self.intercept, self.words = weights, intercept, {}

    def __getstate__(self):
        return {"weights": self.weights, "intercept": self.intercept, "words": {}}

    def weight(self, word: bytes) -> float:
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        w = self.weights.get(feature(word), 0.0)
        if len(word) <= LONG_WORD:
            self.words[word] = w
        return w

    def logits(self, text: bytes | None) -> np.ndarray:
        get, fresh = self.words.get, self.weight
        out = []
        for s in sentences(text):
            z = 0.0
            for w in set(s):
                x = get(w)
                z += fresh(w) if x is None else x
            out.append(z)
        return np.array(out) + (self.intercept or 0.0)

    def score(self, text: bytes | None) -> float:
        if self.intercept is None:
            return 0.0
        z = self.logits(text)
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0


def fit(y: np.ndarray, plain: np.ndarray, doc: np.ndarray, entry_sentence: np.ndarray, entry_word: np.ndarray, start: np.ndarray, steps: int = 400, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the noisy-or likelihood. plain: sentences without a feature, by document; doc: document of each other sentence; entries: (sentence, word)."""
    n, m = len(y), len(start)
    theta = np.append(start, -6.0)
    one, two = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        w, b = theta[:m], theta[m]
        z = b + np.bincount(entry_sentence, weights=w[entry_word], minlength=len(doc))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clean = np.bincount(doc, weights=np.logaddexp(0, z), minlength=n) + plain * np.logaddexp(0, b)
        scale = np.where(y > 0, -1 / np.expm1(np.clip(clean, 1e-9, 30)), 1.0)  # d loss / d (-log(1 - P))
        dz = scale[doc] * p
        grad = np.append(np.bincount(entry_word, weights=dz[entry_sentence], minlength=m), dz.sum() + (scale * plain).sum() * p0) / n
        grad[:m] += decay * w
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad**2
        theta = theta - 0.1 * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
    return theta[:m], float(theta[m])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, min_z: float = MIN_Z, min_odds: float = MIN_ODDS) -> Model:
    """Learn from the labelled rows that are not held out. A lower ``min_z`` or ``min_odds`` makes more words features."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = docs_view(docs).select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = cut(texts, "toxicity-sample")  # three jobs read it

    def words(batches):
        for b in batches:
            sets = [np.fromiter({feature(w) for s in sentences(t) for w in s}, dtype=np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), list_column(sets, pa.int64())], names=["toxic", "words"])

    counted = texts.mapInArrow(words, "toxic int, words array<long>").select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") != 1).alias("good"))
    totals = texts.groupBy("toxic").count().collect()
    bad, good = sum(r[1] for r in totals if r[0] == 1), sum(r[1] for r in totals if r[0] != 1)
    if not bad:
        return Model({}, None)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    n, share = F.col("bad") + F.col("good"), bad / (bad + good)
    ratio = F.col("bad") * F.log(F.col("bad") / (n * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
    chosen = counted.filter("bad > 0").withColumn("odds", odds).filter((F.col("odds") > min_odds) & (2 * ratio > min_z**2)).orderBy("word").collect()
    chosen = [(r["word"], r["odds"]) for r in chosen]
    at = {w: k for k, (w, _) in enumerate(chosen)}

    def bags(batches):
        for b in batches:
            plain, entries = [], []
            for t in b.column("text").to_pylist():
                hits = [sorted({at[f] for w in s if (f := feature(w)) in at}) for s in sentences(t)]
                plain.append(sum(not h for h in hits))
                entries.append([h for h in hits if h])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(plain, pa.int64()), pa.array(entries, pa.list_(pa.list_(pa.int32())))], names=["toxic", "plain", "entries"])

    bag = texts.mapInArrow(bags, "toxic int, plain long, entries array<array<int>>").toArrow()
    doc, sent, word = [], [], []
    for k, hits in enumerate(bag.column("entries").to_pylist()):
        for h in hits:
            sent += [len(doc)] * len(h)
            word += h
            doc.append(k)
    y = (bag.column("toxic").to_numpy() == 1).astype(float)
    ints = lambda x: np.array(x, dtype=np.int64)
    drop(texts)
    w, b = fit(y, bag.column("plain").to_numpy().astype(float), ints(doc), ints(sent), ints(word), np.array([o for _, o in chosen], dtype=float))
    return Model({f: float(x) for (f, _), x in zip(chosen, w)}, b)


def scorer(model: Model, spark: SparkSession):
    """The score of a text column, as a column function."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return lambda text: score(F.col(text).cast("binary"))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, score) of the sentences that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not t or shared.value.intercept is None:
                    continue
                parts = [s for s in SENTENCE.split(t) if s.lower().translate(LETTERS).split()]
                rows += [(i, s.strip().decode("utf-8", "replace"), float(p)) for s, p in zip(parts, 1 / (1 + np.exp(-shared.value.logits(t)))) if p >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["doc_id", "sentence", "score"])

    return docs_view(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, sentence string, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: held_out, score and predicted."""
    score = scorer(train(docs, labels), docs.sparkSession)
    return docs_view(docs).select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op5_toxicity": op5_toxicity}
