"""Toxicity: a classifier chain over categories, trained with out-of-fold predictions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import forget, stored, table
from granary.llm.linear import Rows, logistic, sigmoid

#: Kinds of toxicity that are told apart where the labels name none: the chain's first categories.
KINDS = 3
#: The labelled rows that are learned from: about so many, by a hash of doc_id.
SAMPLE = 20_000
FEATURES = 2_000
LEAST_ROWS = 4
#: Features that a task counts before it sends them on, however few texts a batch has.
COUNTED = 80_000
#: Log-likelihood ratio (in nats) that a word needs: about one word in 100,000 has it by chance.
LEAST_GAIN = 10.0
FOLDS = 5
THRESHOLD = 0.5

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features as well: what inflected words share.
STEMS = (4, 5, 6, 7)


def features_in(text: str) -> set[str]:
    """Distinct runs of letters, lower-cased, and their beginnings (marked by ``*``)."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def sampled(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and label of about ``most`` labelled documents at most: those of the lowest hashes, so a bounded table.

    Null ids and labels are left out; of several labels of a document the largest counts.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    n = one.count()
    if n > most:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return one


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, categories: tuple[str, ...] = ()) -> DataFrame:
    """label, fold (by the text), text and named categories (null: unknown) of the sampled documents, exact copies left out; a stored table."""
    sample = sampled(labels, "toxic", most)
    if categories:
        named = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("int")).alias(f"_c{i}") for i, c in enumerate(categories)))
        sample = sample.join(named, "doc_id", "left")
    names = [f"_c{i}" for i in range(len(categories))]
    text = F.coalesce(F.col("text"), F.lit(""))
    # at most about ``most`` rows of a few numbers are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.select("label", F.xxhash64("text").alias("h"), "text", *names).dropDuplicates(["label", "h"])  # copies say nothing new
    return stored(rows.select("label", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "text", *names), "labelled")


def kinds(x: Rows, toxic: np.ndarray, k: int = KINDS, rounds: int = 30) -> np.ndarray:
    """For each row its kind of toxicity (0 to k - 1; -1: not toxic): spherical k-means over the toxic rows' features, from rows far from one another.

    Features weigh by how few of the toxic rows have them, so kinds differ in their words, not
    in what all of them share. Kinds are numbered by size; the same rows give the same kinds.
    """
    out = np.full(x.n, -1, np.int64)
    at = np.flatnonzero(toxic > 0)
    if not len(at) or not x.width:
        return out
    own = x.take(at)
    held = own.back(np.ones(own.n))
    weight = np.log((1.0 + own.n) / (1.0 + held))
    norm = np.sqrt(np.maximum(own.dot(weight**2), 1e-12))
    near = lambda centre: own.dot(centre * weight) / norm
    unit = lambda part: (lambda c: c / max(1e-12, float(np.sqrt(c @ c))))(own.back(part / norm) * weight)
    centres = [unit(np.ones(own.n))]
    best = near(centres[0])
    for _ in range(k):  # each time the row that is least like the centres so far
        one = np.zeros(own.n)
        one[int(np.argmin(best))] = 1.0
        centres.append(unit(one))
        best = np.maximum(best, near(centres[-1])) if len(centres) > 2 else near(centres[-1])
    centres = centres[1:]
    of = np.full(own.n, -1)
    for _ in range(rounds):
        new = np.argmax(np.stack([near(c) for c in centres]), axis=0)
        if np.array_equal(new, of):
            break
        of = new
        centres = [unit((of == j).astype(float)) for j in range(k)]
    rank = np.empty(k, np.int64)
    rank[np.argsort(-np.bincount(of, minlength=k), kind="stable")] = np.arange(k)
    out[at] = rank[of]
    return out


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n and a: texts and toxic texts that hold it; summed where they are read, COUNTED features or a few more at a time, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        a: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([a[x] for x in n], pa.int64())], ["feature", "n", "a"])
            n.clear()
            a.clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features_in(text)
                n.update(found)
                if label > 0:
                    a.update(found)
            if len(n) >= COUNTED:
                yield counted()
        yield counted()

    return rows.select("label", "text").mapInArrow(run, "feature string, n long, a long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


class Chain:
    """Models of the categories in turn; each sees the words and the log-odds of the categories before it."""

    def __init__(self, names: list[str], vocabulary: list[str], models: list[tuple[np.ndarray, np.ndarray, float]]):
        self.names, self.vocabulary, self.models = names, vocabulary, models
        self.number = {w: i for i, w in enumerate(vocabulary)}

    def found(self, text: str) -> list[int]:
        return [self.number[w] for w in features_in(text) & self.number.keys()]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        rows = Rows([self.found(t) for t in texts], len(self.vocabulary))
        odds = np.zeros((len(texts), 0))
        for w, chained, bias in self.models:
            odds = np.column_stack([odds, np.clip(rows.dot(w) + odds @ chained + bias, -8, 8)])
        return sigmoid(odds)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, features: int = FEATURES, categories: tuple[str, ...] = ()) -> Chain:
    """Learns the chain from a bounded sample of labelled rows (``most``).

    The categories are columns of ``labels`` (0 or 1; null: not of it), in the order given, or
    without any the kinds of toxicity that the toxic rows fall into by their words (``kinds``);
    the label toxic is the last one, and decides.
    Words and stems are picked by their log-likelihood ratio with the label, over the whole
    sample, on the executors; the driver gets the picked ones of each sampled row. In
    training, a category's log-odds that feed the later ones are out of fold: made by models
    that didn't see the row. Without labelled rows every probability is next to 0.
    """
    rows = labelled_texts(docs, labels, most, categories)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()
    vocabulary: list[str] = []
    if 0 < ones < n:
        share, b = ones / n, F.col("n") - F.col("a")
        part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
        gain = part(F.col("a"), F.col("n") * share) + part(b, F.col("n") * (1 - share)) + part(ones - F.col("a"), (n - F.col("n")) * share) + part(n - ones - b, (n - F.col("n")) * (1 - share))
        picked = feature_counts(rows).where(f"n >= {LEAST_ROWS}").select("feature", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(features)
        vocabulary = [r["feature"] for r in picked.collect()]
    empty = docs.sparkSession.sparkContext.broadcast(Chain([], vocabulary, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(empty.value.found(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), *batch.columns[3:]], ["label", "fold", "features", *rows_named])

    rows_named = [f"_c{i}" for i in range(len(categories))]
    got = rows.mapInArrow(run, ", ".join(["label int, fold int, features array<int>", *(f"{c} int" for c in rows_named)])).toArrow().to_pylist()
    forget(rows)
    got.sort(key=lambda r: (r["fold"], r["label"], r["features"], [r[c] or 0 for c in rows_named]))
    x = Rows([r["features"] for r in got], len(vocabulary))
    fold = np.array([r["fold"] for r in got], np.int64)
    toxic = np.array([r["label"] > 0 for r in got], float)
    if categories:
        held = {c: np.array([(r[f"_c{i}"] or 0) > 0 for r in got], float) for i, c in enumerate(categories)}
    else:
        kind = kinds(x, toxic)
        held = {f"kind_{j + 1}": (kind == j).astype(float) for j in range(KINDS)}
    names = [*held, "toxic"]
    odds, models = np.zeros((x.n, 0)), []
    for name in names:
        y = held.get(name, toxic)
        models.append(logistic(x, odds, y))
        held_out = np.zeros(x.n)
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(test):
                w, chained, bias = logistic(x.take(train), odds[train], y[train])
                held_out[test] = x.take(test).dot(w) + odds[test] @ chained + bias
        odds = np.column_stack([odds, np.clip(held_out, -8, 8)])
    return Chain(names, vocabulary, models)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability for each category and toxic (the last is THRESHOLD or more) of every whole text.

    One row for each row of ``docs``. A null or empty text has no words and so the models'
    bare odds. Repeated rows and null ids stay; other columns are ignored; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES words and weights
    names = [f"p_{x}" for x in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(len(names))), pa.array(p[:, -1] >= THRESHOLD)], ["doc_id", *names, "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{x} double' for x in names)}, toxic boolean")


def not_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the chain doesn't call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(p[:, -1] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
