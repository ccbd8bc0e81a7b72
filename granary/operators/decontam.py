"""Decontamination by n-gram candidates and token alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import match_ratio
from granary.functions.text import tokens
from granary.sources.files import exists


def ngrams(tokens: str | Column, n: int, tail: bool = False) -> Column:
    """All distinct windows of ``n`` tokens, joined by blanks. Without ``tail`` the last one is left out, as in the records to match (B1)."""
    last = F.size(tokens) - n + (1 if tail else 0)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def hashed(tokens: str | Column, n: int, tail: bool = False) -> Column:
    """``ngrams`` as 64-bit hashes, repeats included: eight bytes instead of eight words.

    The tokens' hashes are bound to a lambda's variable: what a lambda only refers to is evaluated
    again at each use, so that a text would cost its tokens squared.
    """

    def windows(token: Column) -> Column:
        last = F.size(token) - n + (1 if tail else 0)
        window = lambda i: F.xxhash64(*(F.get(token, i + j) for j in range(n)))
        return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), window)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.transform(tokens, lambda x: F.xxhash64(x))), windows), F.lit(0))


def subwords(path: str) -> Callable[[str | Column], Column]:
    """A tokenizer file's token ids as a function of a text column, for ``tokenizer`` below (FN25); every executor must have the file."""

    def of(text: str | Column) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            for texts in batches:
                yield pd.Series([x.ids for x in library.encode_batch([t or "" for t in texts])])

        return F.pandas_udf(run, "array<bigint>")(F.col(text) if isinstance(text, str) else text)

    return of


def exploded(rows: DataFrame, key: str, text: str, n: int, tail: bool = False) -> DataFrame:
    """(key, ngram) rows (UDT2)."""
    return rows.select(key, tokens(text).alias("t")).select(key, F.explode(ngrams("t", n, tail)).alias("ngram"))


def indexed(rows: DataFrame, key: str, n: int = 8, tail: bool = False, tokenizer: Callable[[str], Column] = tokens) -> DataFrame:
    """(key, ngram) rows with n-grams as 64-bit hashes: the inverted index of a table. Tokens are made once, before they are cut into n-grams."""
    return rows.select(key, tokenizer("text").alias("t")).select(key, F.explode(hashed("t", n, tail)).alias("ngram"))


def prefiltered(train: DataFrame, items: DataFrame, key: str, n: int = 8, tokenizer: Callable[[str], Column] = tokens) -> DataFrame:
    """Keys of training rows that share any n-gram with any item: a left-semi join of hashes (JN1)."""
    wanted = indexed(items, "item_id", n, tokenizer=tokenizer).select("ngram").distinct()
    return indexed(train, key, n, tokenizer=tokenizer).join(wanted, "ngram", "left_semi").select(key).distinct()


def candidates(train: DataFrame, items: DataFrame, key: str, item: str, n: int = 8, tokenizer: Callable[[str], Column] = tokens) -> DataFrame:
    """Distinct (key, item) pairs that share an n-gram: the items' n-grams are the inverted index (JN2).

    N-grams go as 64-bit hashes; Spark broadcasts the index when its size allows, and filters
    the other side by it before an exchange when not. A pair by collision alone has a chance
    of (training n-grams times benchmark n-grams) / 2^64, and falls at the alignment.
    """
    index = indexed(items, item, n, tokenizer=tokenizer).distinct()
    return indexed(train, key, n, tokenizer=tokenizer).join(index, "ngram").select(key, item).distinct()


def verified(pairs: DataFrame, train: DataFrame, items: DataFrame, key: str, item: str, theta: float = 0.5, tokenizer: Callable[[str], Column] = tokens) -> DataFrame:
    """The pairs with their alignment ratio, from ``theta`` on (JN3). Only candidates' texts are aligned, a batch at a time."""
    held = train.join(pairs.select(key).distinct(), key, "left_semi")
    rows = pairs.join(items.select(item, tokenizer("text").alias("eval")), item).join(held.select(key, tokenizer("text").alias("train")), key)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ratio = [match_ratio(list(a), list(b)) for a, b in zip(rows["train"], rows["eval"], strict=True)]
            yield rows[[key, item]].assign(match_ratio=ratio)

    return rows.select(key, item, "train", "eval").mapInPandas(run, f"{key} {kinds[key]}, {item} {kinds[item]}, match_ratio double").where(F.col("match_ratio") >= theta)


def report(found: DataFrame, key: str, item: str) -> DataFrame:
    """One row for each contaminated key: the smallest item and the largest ratio (B5), so no order bears on it."""
    return found.groupBy(key).agg(F.min(item).alias(item), F.max("match_ratio").alias("match_ratio"))


def decontaminated(train: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Training rows without the contaminated ones, of all reports together (JN4, SET2, FLT8, B2)."""
    return train.join(found.select(key).distinct(), key, "left_anti")


def reports(train: DataFrame, items: DataFrame, path: str, key: str, item: str, benchmark: str = "benchmark", overwrite: bool = False, theta: float = 0.5) -> DataFrame:
    """The contaminated keys of each benchmark of ``items``, one folder of ``path`` for each (ITR5, SNK4).

    Benchmarks whose report is there already are left out unless ``overwrite``; all reports that
    were asked for, old ones too, are read back, so that the filter that follows misses none.
    """
    spark = train.sparkSession
    names = sorted(r[0] for r in items.select(F.col(benchmark).cast("string")).distinct().collect())  # names of benchmarks
    folder = {name: f"{path}/{benchmark}={name.replace('/', '_')}" for name in names}
    for name, at in folder.items():
        if overwrite or not exists(spark, at):
            of = items.where(F.col(benchmark).cast("string") == name)
            found = report(verified(candidates(train, of, key, item), train, of, key, item, theta), key, item)
            found.write.mode("overwrite").parquet(at)
    schema = f"{key} {dict(train.dtypes)[key]}, {item} {dict(items.dtypes)[item]}, match_ratio double, {benchmark} string"
    return spark.read.schema(schema).option("basePath", path).parquet(*folder.values())


def contamination_counts(found: DataFrame, key: str, benchmark: str, top: int = 20) -> DataFrame:
    """Contaminated rows by benchmark, most first (AGG28)."""
    return found.groupBy(benchmark).agg(F.countDistinct(key).alias("n")).orderBy(F.desc("n"), benchmark).limit(top)


PROMPTS = {
    # benchmark formats (PRJ8): stem and options, the question itself, contexts and question
    "endings": lambda: F.concat_ws("\n", "sent1", "ending0", "ending1", "ending2", "ending3"),
    "question": lambda: F.col("question"),
    "contexts": lambda: F.concat(F.array_join("CONTEXTS", "\n"), F.lit("\n"), F.col("QUESTION")),
    "options": lambda: F.concat_ws("\n", "question", "opa", "opb", "opc", "opd"),
    # training formats (PRJ3): first human turn, a named column, first message
    "sharegpt": lambda roles=("human",): F.coalesce(F.get(F.filter("conversations", lambda t: t["from"].isin(*roles)), F.lit(0))["value"], F.lit("")),
    "flat": lambda column="text": F.coalesce(F.col(column), F.lit("")),
    "default": lambda: F.coalesce(F.get("initial_prompt", F.lit(0))["content"], F.lit("")),
}
