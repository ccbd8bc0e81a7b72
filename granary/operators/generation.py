"""Model replies as tables: prompts, cached answers, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import n_tokens

#: Tokens that a prompt may have: the window less the reply's room and a margin.
BUDGET = 131072 - 8192 - 512


def prompt_key(prompt: str | Column, temperature: float, most: int) -> Column:
    """Key of an answer in a cache: settings and the prompt's hash (PRJ20); of a list of messages, of ``messages_json``."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.concat(F.lit(f"t{temperature}_n{most}_"), F.sha2(p, 256))


def messages_json(messages: str | Column) -> Column:
    """(role, content) messages as JSON with sorted keys, a blank behind each colon and comma, other letters than ASCII as they are."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r"(?s)^\{.x.:(.*)\}$", 1)
    entry = lambda m: F.concat(F.lit('{"content": '), quoted(m["content"]), F.lit(', "role": '), quoted(m["role"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(messages, entry), ", "), F.lit("]"))


def completion_id(prompt_id: str, completion: str) -> Column:
    return F.sha2(F.concat(F.col(prompt_id), F.col(completion)), 256)


def latest(cache: DataFrame, order: str) -> DataFrame:
    """(key, answer): of a key's answers the last one (JN6)."""
    return cache.groupBy("key").agg(F.max_by("answer", order).alias("answer"))


def answered(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """The prompts (with ``key``) and their cached answers; null where there is none."""
    return prompts.join(cache.select("key", "answer"), "key", "left")


def missing(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts without an answer, each once: what a model still has to do (JN5, SET4)."""
    return prompts.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def generate(prompts: DataFrame, cache: DataFrame, model: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """(prompts with answers, the cache with what is new): ``model`` turns (key, prompt) rows into (key, answer) (UDT4, JN6).

    The model runs once: its answers are appended to ``path`` and read from there for both.
    """
    spark, schema = prompts.sparkSession, "key string, answer string"
    model(missing(prompts, cache)).select("key", "answer").write.mode("append").parquet(path)
    grown = cache.select("key", "answer").unionByName(spark.read.schema(schema).parquet(path)).dropDuplicates(["key"])
    return answered(prompts, grown), grown


def retried(prompts: DataFrame, model: Callable[[DataFrame, float], DataFrame], valid: Callable[[str], Column], path: str, retries: int = 3, temperature: float = 0.0) -> DataFrame:
    """(key, answer, attempt) of every prompt: asked again, a little warmer each time, until its answer is valid (ITR2, ITR3).

    ``model`` takes what is still open and a temperature. Each attempt is written to ``path``
    once; only prompts without a valid answer go on, and of those that never get one the last
    answer stays.
    """
    spark, left = prompts.sparkSession, prompts
    for attempt in range(retries + 1):
        asked = model(left, min(1.0, temperature + 0.2 * attempt))
        asked.select("key", "answer", F.lit(attempt).alias("attempt")).write.mode("append").parquet(path)
        done = spark.read.schema("key string, answer string, attempt int").parquet(path)
        left = prompts.join(done.where(valid("answer")).select("key").distinct(), "key", "left_anti")
        if left.isEmpty():
            break
    return done.groupBy("key").agg(F.max_by("answer", "attempt").alias("answer"), F.max("attempt").alias("attempt"))


def within_budget(text: str, most: int = BUDGET) -> Column:
    return n_tokens(text) <= most


def to_retry(attempt: int, resume: bool, label: str, match: str) -> Column:
    """Rows of an attempt: all at first (unless resumed), later the labelled ones without a match (FLT9, B16)."""
    if attempt == 1 and not resume:
        return F.lit(True)
    return (F.coalesce(F.col(label), F.lit("")) != "") & ~F.coalesce(F.col(match), F.lit(False))


def accepted(attempts: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Rejection sampling in closed form (ITR1-2): the first attempt that matches, else the last one.

    ``attempts`` has (key, attempt, text, match); ``match`` is null without a label, where
    the first attempt stays. One aggregation, whatever the number of attempts.
    """
    row = F.struct(F.col("attempt").alias("try_count"), "text", F.col("match").alias("exact_match"))
    hit = F.min_by(row, F.when(F.col("match"), F.col("attempt")))
    kept = F.when(F.max("match").isNull(), F.min_by(row, "attempt")).otherwise(F.coalesce(hit, F.max_by(row, "attempt")))
    return attempts.where(F.col("attempt") <= most).groupBy(key).agg(kept.alias("_kept")).select(key, "_kept.*")


def attempt_accuracy(attempts: DataFrame) -> DataFrame:
    """Matches among the labelled rows of each attempt (AGG13)."""
    return attempts.groupBy("attempt").agg(F.count("match").alias("labelled"), F.count_if("match").alias("matched")).withColumn("accuracy", F.try_divide("matched", "labelled"))


def pattern_counts(attempts: DataFrame) -> DataFrame:
    """How many matches, over all attempts, each pattern gave (AGG13); ``pattern`` null counts as none."""
    return attempts.where("match").groupBy(F.coalesce("pattern", F.lit("none")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
