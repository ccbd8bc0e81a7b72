"""Distribution shift between two arms."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of the values' range that running sums are taken in.
RANGES = 64


def proportions(rows: DataFrame, arm: str, value: str, vocabulary: DataFrame) -> DataFrame:
    """(arm, category, n, p) over the whole vocabulary (column ``category``), with zeros; other values don't count (AGG4, JN11)."""
    counts = rows.groupBy(F.col(arm).alias("arm"), F.col(value).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    arms = counts.agg(F.collect_set("arm")).scalar()  # two or so
    every = vocabulary.select("category").distinct().select(F.explode(arms).alias("arm"), "category")
    out = every.join(counts, ["arm", "category"], "left").select("arm", "category", F.coalesce("n", F.lit(0)).alias("n"))
    totals = out.groupBy("arm").agg(F.sum("n").alias("_all"))
    return out.join(F.broadcast(totals), "arm").select("arm", "category", "n", F.coalesce(F.try_divide("n", "_all"), F.lit(0.0)).alias("p"))


def aligned(shares: DataFrame, a: str, b: str) -> DataFrame:
    """(category, p, q): both arms' shares side by side (JN12)."""
    of = lambda arm, name: F.sum(F.when(F.col("arm") == arm, F.col("p")).otherwise(0.0)).alias(name)
    return shares.groupBy("category").agg(of(a, "p"), of(b, "q"))


def jensen_shannon(p: str = "p", q: str = "q") -> Column:
    """Aggregate: divergence in bits, between 0 and 1; 0 * log 0 is 0 (AGG5)."""
    m = (F.col(p) + F.col(q)) / 2
    part = lambda x: F.coalesce(F.sum(F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m))), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (part(p) + part(q)) / 2))


def total_variation(p: str = "p", q: str = "q") -> Column:
    """Aggregate: half the sum of the differences (AGG6)."""
    return F.sum(F.abs(F.col(p) - F.col(q))) / 2


def wasserstein(rows: DataFrame, arm: str, value: str, a: str, b: str) -> DataFrame:
    """One row: the area between the two arms' distribution functions; NaN if an arm is empty (AGG7, WIN3).

    Values are counted first, so the running sums go over distinct values only. These are cut
    into RANGES ranges by quantiles; a range's sums start from those of the ranges before, and
    its last gap ends at the next range's first value, so no task sees all values.
    """
    of = lambda x: F.count_if(F.col(arm) == x)
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(of(a).alias("na"), of(b).alias("nb"))
    bounds = counts.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000)).first()[0]  # fewer than RANGES numbers
    counts = counts.withColumn("range", sum(((F.col("v") > x).cast("int") for x in sorted(set(bounds or []))), F.lit(0)))
    w, ranges = Window.partitionBy("range").orderBy("v"), Window.orderBy("range")
    sums = counts.groupBy("range").agg(F.sum("na").alias("ra"), F.sum("nb").alias("rb"), F.min("v").alias("least"))  # at most RANGES rows
    before = sums.select("range", (F.sum("ra").over(ranges) - F.col("ra")).alias("pa"), (F.sum("rb").over(ranges) - F.col("rb")).alias("pb"), F.lead("least").over(ranges).alias("next"), F.sum("ra").over(Window.partitionBy()).alias("ta"), F.sum("rb").over(Window.partitionBy()).alias("tb"))
    gaps = counts.join(F.broadcast(before), "range").select(
        (F.col("pa") + F.sum("na").over(w)).alias("ca"),
        (F.col("pb") + F.sum("nb").over(w)).alias("cb"),
        "ta",
        "tb",
        (F.coalesce(F.lead("v").over(w), F.col("next")) - F.col("v")).alias("width"),
    )
    area = F.sum(F.abs(F.try_divide("ca", "ta") - F.try_divide("cb", "tb")) * F.coalesce("width", F.lit(0.0)))
    return gaps.agg(F.when((F.max("ta") > 0) & (F.max("tb") > 0), area).otherwise(F.lit(float("nan"))).alias("w1"))


def centres(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """Mean and median of each arm (AGG8)."""
    return rows.groupBy(F.col(arm).alias("arm")).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))


def seed_of(*parts: str) -> int:
    """As functions.text.seed_of, on the driver."""
    return int.from_bytes(hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).digest()[:4], "big")


def shares_jsd(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = sum(np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q))
    return float(min(1.0, max(0.0, kl / 2)))


def bootstrap_counts(counts: DataFrame, group: list[str], metric: Callable[[np.ndarray, np.ndarray], float] = shares_jsd, times: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Point and percentile interval of a metric on two arms' shares, for each group (AGG9).

    ``counts`` has a row for each group and category, with ``n_a`` and ``n_b``. Resampling rows
    with replacement is a multinomial draw of the categories' counts, so the work depends on the
    number of categories, not of rows. Each group is seeded by its name.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("category")
        name = [str(rows[g].iloc[0]) for g in group]
        random = np.random.default_rng(seed_of(*name))
        a, b = rows["n_a"].to_numpy(float), rows["n_b"].to_numpy(float)
        if not a.sum() or not b.sum():
            out = (math.nan,) * 3
        else:
            draws = [random.multinomial(int(x.sum()), x / x.sum(), times) / x.sum() for x in (a, b)]
            stats = np.array([metric(p, q) for p, q in zip(*draws, strict=True)])
            out = (metric(a / a.sum(), b / b.sum()), float(np.quantile(stats, alpha / 2)), float(np.quantile(stats, 1 - alpha / 2)))
        return pd.DataFrame([[*(rows[g].iloc[0] for g in group), *out, int(a.sum()), int(b.sum())]], columns=[*group, "value", "ci_low", "ci_high", "n_a", "n_b"])

    kinds = dict(counts.dtypes)
    return counts.groupBy(*group).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", value double, ci_low double, ci_high double, n_a long, n_b long")


def bca(values: np.ndarray, stat: Callable[[np.ndarray], float] = np.mean, times: int = 1000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Bias-corrected and accelerated interval (Efron 1987); percentile where that is undefined; NaN without values (AGG10)."""
    values = np.asarray(values, float)
    if not len(values):
        return math.nan, math.nan
    random, norm = np.random.default_rng(seed), NormalDist()
    point = stat(values)
    draws = np.sort([stat(values[random.integers(0, len(values), len(values))]) for _ in range(times)])
    below = ((draws < point).sum() + 0.5 * (draws == point).sum()) / times
    jack = np.array([stat(np.delete(values, i)) for i in range(len(values))]) if len(values) > 1 else np.zeros(1)
    gap = jack.mean() - jack
    spread = (gap**2).sum() ** 1.5
    if not 0 < below < 1 or not spread:
        return float(np.quantile(draws, alpha / 2)), float(np.quantile(draws, 1 - alpha / 2))
    z0, a = norm.inv_cdf(below), (gap**3).sum() / (6 * spread)
    level = lambda z: norm.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
    return tuple(float(np.quantile(draws, level(norm.inv_cdf(x)))) for x in (alpha / 2, 1 - alpha / 2))


def matrix(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A table of one value for each row and each of the given columns (AGG32)."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(value))
