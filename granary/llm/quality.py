"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import forget, hashed_words, lists, steps, stored, table
from granary.llm.linear import Rows, hinge, platt, sigmoid
from granary.llm.toxicity import sampled

#: The labelled rows that are learned from: about so many, by a hash of doc_id.
SAMPLE = 8_000
FEATURES = 2_000
#: Log-likelihood ratio (in nats) and number of texts that an n-gram needs.
LEAST_GAIN, LEAST_ROWS = 8.0, 5
FOLDS = 3
THRESHOLD = 0.7
#: Slots of the table from n-gram hashes to features.
SLOTS = 1 << 22
#: Word n-grams of one repeated word, of so many words: kept under keys that no characters have.
RUNS = (2, 3, 5, 8)
_RUN_KEY = 1 << 62


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of all character 1- to 3-grams, with repeats, and of the runs of one word that each text holds."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    data = np.concatenate([np.empty(0, np.uint32), *points]).astype(np.int64) + 1
    of = np.repeat(np.arange(len(texts)), lengths)
    where, keys = [of], [data]
    for n in (2, 3):
        key = sum(data[i : len(data) - n + 1 + i] << (21 * (n - 1 - i)) for i in range(n)) if len(data) >= n else np.empty(0, np.int64)
        inside = of[: len(key)] == of[n - 1 :]
        where.append(of[: len(key)][inside])
        keys.append(key[inside])
    words, counts = hashed_words([t.encode() for t in texts])
    word_of = np.repeat(np.arange(len(texts)), counts)
    again = (words[1:] == words[:-1]) & (word_of[1:] == word_of[:-1])
    # the number of repeats on end at each word
    ends = np.arange(1, len(again) + 1)
    run = ends - np.maximum.accumulate(np.where(again, 0, ends)) if len(again) else ends
    for k in RUNS:
        at = np.unique(word_of[1:][run >= k - 1]) if len(run) else np.empty(0, np.int64)
        where.append(at)
        keys.append(np.full(len(at), _RUN_KEY + k, np.int64))
    return np.concatenate(where), np.concatenate(keys)


class Model:
    """Weights by n-gram key, looked up in a table of hash slots without collisions."""

    def __init__(self, keys: list[int]):
        self.keys = np.array(keys, np.int64)
        self.shift = np.uint64(64 - SLOTS.bit_length() + 1)
        self.odd = next(m for m in self._multipliers() if len(np.unique((self.keys.view(np.uint64) * m) >> self.shift)) == len(keys))
        self.slots = np.full(SLOTS, -1, np.int16)
        self.slots[((self.keys.view(np.uint64) * self.odd) >> self.shift).astype(np.int64)] = np.arange(len(keys), dtype=np.int16)
        self.weights, self.bias, self.a, self.b = np.zeros(len(keys)), 0.0, 1.0, 0.0

    @staticmethod
    def _multipliers() -> Iterator[np.uint64]:
        m = 0x9E3779B97F4A7C15
        while True:
            yield np.uint64(m)
            m = (m * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature number) pairs, each once, in order."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where, keys = grams(texts)
        at = self.slots[((keys.view(np.uint64) * self.odd) >> self.shift).astype(np.int64)]
        hit = at >= 0
        where, keys, at = where[hit], keys[hit], at[hit].astype(np.int64)
        true = self.keys[at] == keys
        pairs = np.unique(where[true] * len(self.keys) + at[true])
        return pairs // len(self.keys), pairs % len(self.keys)

    def scores(self, texts: list[str]) -> np.ndarray:
        where, feature = self.features(texts)
        margin = np.bincount(where, self.weights[feature], len(texts)) + self.bias
        return sigmoid(self.a * margin + self.b)


def ratios(x: Rows, good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the smoothed share of each n-gram among the good rows' n-grams over that among the others'."""
    p, q = smooth + x.back(good.astype(float)), smooth + x.back(1.0 - good)
    return np.log(p / p.sum()) - np.log(q / q.sum()) if x.width else p


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, features: int = FEATURES) -> Model:
    """Learns from about ``most`` labelled rows, chosen by a hash of doc_id.

    N-grams are counted on the executors over the whole sample, and those of the largest
    log-likelihood ratio kept; the driver gets the sample's kept n-grams as numbers. Margins
    become probabilities by a logistic curve through cross-fitted margins. With one class or
    none, every score is the smoothed share of good rows.
    """
    sample = F.broadcast(sampled(labels, "quality", most))  # at most about ``most`` rows of two numbers
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(sample, "doc_id")
    rows = stored(rows.select("label", "text", F.xxhash64("text").alias("h")).dropDuplicates(["label", "h"]), "labelled")  # copies say nothing new
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()
    keys: list[int] = []
    if 0 < ones < n:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, texts = batch.column(0).to_numpy() > 0, batch.column(1).to_pylist()
                for a, b in steps([t.encode() for t in texts]):
                    where, key = grams(texts[a:b])
                    order = np.lexsort((where, key))
                    where, key = where[order], key[order]
                    first = np.ones(len(key), bool)
                    first[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1])
                    where, key = where[first], key[first]
                    every, at, count = np.unique(key, return_inverse=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(count.astype(np.int64)), pa.array(np.bincount(at, good[a:b][where], len(every)).astype(np.int64))], ["key", "n", "a"])

        counts = rows.select("label", "text").mapInArrow(run, "key long, n long, a long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
        share, c = ones / n, F.col("n") - F.col("a")
        part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
        gain = part(F.col("a"), F.col("n") * share) + part(c, F.col("n") * (1 - share)) + part(ones - F.col("a"), (n - F.col("n")) * share) + part(n - ones - c, (n - F.col("n")) * (1 - share))
        picked = counts.where(f"n >= {LEAST_ROWS} and n < {n}").select("key", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "key").limit(features)
        keys = [r["key"] for r in picked.collect()]
    model = Model(keys)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in steps([t.encode() for t in texts]):
                where, feature = shared.value.features(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists(feature, np.bincount(where, minlength=b - a))], ["label", "h", "features"])

    got = rows.mapInArrow(found, "label int, h long, features array<long>").orderBy("h", "label").toArrow()
    forget(rows)
    good = got["label"].to_numpy() > 0
    x = Rows(got["features"].to_pylist(), len(keys))
    fold = got["h"].to_numpy() % FOLDS
    if not 0 < ones < n:
        model.bias = float(np.log((ones + 0.5) / (n - ones + 0.5)))
        return model
    margins = np.zeros(x.n)
    for f in range(FOLDS):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(test) and 0 < good[train].sum() < len(train):
            part_x = x.take(train)
            w, bias = _svm(part_x, good[train])
            margins[test] = x.take(test).dot(w) + bias
    model.weights, model.bias = _svm(x, good)
    model.a, model.b = platt(margins, good.astype(float))
    return model


def _svm(x: Rows, good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the bare indicators: the scale is worked into them."""
    r = ratios(x, good)
    w, bias = hinge(x, r, np.where(good, 1.0, -1.0))
    return w * r, bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of every whole text.

    One row for each row of ``docs``; only the text bears on the score. Null and empty texts
    have no n-grams and get the score of the bias alone. held_out is false without a doc_id.
    Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES keys and weights, and the slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in steps([t.encode() for t in texts], 1 << 20):
                p = shared.value.scores(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels").where(~held_out())))
