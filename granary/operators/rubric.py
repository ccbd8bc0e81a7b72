"""Rubric grading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import criteria_met
from granary.operators.divergence import seed_of


def items(examples: DataFrame) -> DataFrame:
    """One row for each example and rubric (UDT1)."""
    return examples.select("prompt_id", "example_tags", F.posexplode("rubrics").alias("rubric", "r")).select("prompt_id", "example_tags", "rubric", "r.criterion", "r.points", "r.tags")


def grader_prompt(template: str) -> Column:
    """The template with the conversation and the rubric put in (PRJ12)."""
    talk = F.array_join(F.transform("prompt", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n\n")
    return F.replace(F.replace(F.lit(template), F.lit("<<conversation>>"), talk), F.lit("<<rubric_item>>"), F.concat(F.lit("["), F.col("points").cast("string"), F.lit("] "), F.col("criterion")))


def grades(items: DataFrame, replies: DataFrame, key: list[str], reply: str = "reply") -> DataFrame:
    """Rubric items with ``met`` from the grader's replies, joined by (example, rubric); null where none says so (JN10)."""
    return items.join(replies.select(*key, criteria_met(reply).alias("met")), key, "left")


def resolved(graded: DataFrame) -> DataFrame:
    """Grades that never parsed count as not met (ITR3)."""
    return graded.withColumn("met", F.coalesce("met", F.lit(False)))


def score(points: str = "points", met: str = "met") -> Column:
    """Aggregate: points met over all positive points; null without positive points (AGG24, B17)."""
    p = F.col(points)
    return F.try_divide(F.sum(F.when(F.col(met), p).otherwise(0.0)), F.nullif(F.sum(F.when(p > 0, p).otherwise(0.0)), F.lit(0.0)))


def scores(graded: DataFrame, key: str) -> DataFrame:
    return graded.groupBy(key).agg(score().alias("score"))


def tag_scores(graded: DataFrame, key: str, example_tags: DataFrame) -> DataFrame:
    """(key, tag, score): overall, the example's tags at the overall score, and each rubric tag over its own
    rubrics, which wins over an example tag of the same name (AGG25)."""
    overall = scores(graded, key)
    by_example = example_tags.join(overall, key).select(key, F.explode("example_tags").alias("tag"), "score", F.lit(1).alias("rank"))
    by_rubric = graded.select(key, F.explode("tags").alias("tag"), "points", "met").groupBy(key, "tag").agg(score().alias("score")).withColumn("rank", F.lit(0))
    every = overall.select(key, F.lit("overall").alias("tag"), "score", F.lit(0).alias("rank")).unionByName(by_example).unionByName(by_rubric)
    return every.groupBy(key, "tag").agg(F.min_by("score", "rank").alias("score"))


def clipped_means(scored: DataFrame, *group: str) -> DataFrame:
    """Mean clipped to [0, 1] and number of scores (AGG26)."""
    return scored.where("score is not null").groupBy(*group).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("score"))).alias("mean"), F.count(F.lit(1)).alias("n"))


def bootstrap_deviation(scored: DataFrame, *group: str, times: int = 1000, chunk: int = 1 << 14) -> DataFrame:
    """(group, bootstrap_std): deviation of ``times`` resampled means, each clipped to [0, 1] (AGG26).

    A Poisson bootstrap over the counts of distinct scores: in each replicate a score that
    comes n times weighs Poisson(n). Scores are drawn in chunks of a bounded size, seeded by
    name, and the chunks' sums added up, so no group is gathered in one task. The groups'
    columns mustn't be null.
    """
    counts = scored.where("score is not null").groupBy(*group, "score").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_chunks"))
    chunks = counts.join(sizes, list(group)) if group else counts.withColumn("_chunks", sizes.scalar())
    chunks = chunks.withColumn("_chunk", F.pmod(F.xxhash64("score"), F.col("_chunks")))
    kinds = dict(counts.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        name = [str(rows[c].iloc[0]) for c in (*group, "_chunk")]
        weights = np.random.default_rng(seed_of(*name)).poisson(rows["_n"].to_numpy(float), (times, len(rows)))
        out = pd.DataFrame({"replicate": np.arange(times), "s": weights @ rows["score"].to_numpy(float), "w": weights.sum(axis=1)})
        return out.assign(**{g: rows[g].iloc[0] for g in group})[[*group, "replicate", "s", "w"]]

    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "replicate int, s double, w long"])
    sums = chunks.groupBy(*group, "_chunk").applyInPandas(run, schema).groupBy(*group, "replicate").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("s", "w")))
    return sums.groupBy(*group).agg(F.stddev_pop(mean).alias("bootstrap_std"))


def length_adjusted(score: str, length: str, centre: float, penalty: float) -> Column:
    return F.col(score) - penalty * (F.col(length) - centre) / 500


def unmet_first(graded: Column) -> Column:
    """An array of (met, rubric, ...) with the unmet first, else in order (SRT5)."""
    return F.array_sort(graded)
