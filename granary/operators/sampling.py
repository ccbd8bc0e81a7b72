"""Deterministic sampling by hashed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "__unknown__"


def stable_key(seed: str | Column, key: str) -> Column:
    """16 hex digits that order rows alike on any partitioning (SMP1)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.substring(F.sha2(F.concat(seed, F.lit("\0"), F.col(key).cast("string")), 256), 1, 16)


def bottom(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The ``n`` rows of the smallest keys: a distributed top-k (SMP2). Below 0: all rows; 0: none. Ties go by id."""
    return rows if n < 0 else rows.orderBy(stable_key(seed, key), key).limit(n)


def allocation(sizes: DataFrame, n: int, least: int = 1) -> DataFrame:
    """(stratum, size, take): ``least`` each, the rest by headroom, left-over places to the largest fractions (SMP3, WIN6).

    All of it runs over the table of strata: where there are more of them than ``n``, the
    first ``n`` in order get one each.
    """
    every, by_name = Window.partitionBy(), Window.orderBy("stratum")
    rows = sizes.withColumn("total", F.sum("size").over(every)).withColumn("first", F.least(F.lit(least), F.col("size")))
    rows = rows.withColumn("left", F.lit(n) - F.sum("first").over(every)).withColumn("room", F.col("size") - F.col("first"))
    rows = rows.withColumn("share", F.coalesce(F.try_divide(F.col("left") * F.col("room"), F.sum("room").over(every)), F.lit(0.0)))
    rows = rows.withColumn("whole", F.least(F.floor("share"), F.col("room"))).withColumn("spare", F.col("left") - F.sum("whole").over(every))
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.floor("share")), "stratum"))).withColumn("order", F.row_number().over(by_name))
    take = F.when(F.col("total") <= n, F.col("size")).when(F.col("left") < 0, (F.col("order") <= n).cast("int")).otherwise(F.col("first") + F.col("whole") + ((F.col("place") <= F.col("spare")) & (F.col("whole") < F.col("room"))).cast("int"))
    return rows.select("stratum", "size", take.cast("long").alias("take"))


def stratified(rows: DataFrame, n: int, stratum: str, key: str, seed: int = 0, least: int = 1) -> DataFrame:
    """``n`` rows by strata (SMP3). A null stratum is one of its own. Only the strata's counts are gathered in one place.

    The rows of a stratum are ranked in parts of its hash range first, so a stratum of any
    size is never one task: a part gives at most the stratum's number of rows.
    """
    if n < 0:
        return rows
    named = rows.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(UNKNOWN)))
    takes = allocation(named.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), n, least)
    keyed = named.join(takes, "stratum").withColumn("_key", stable_key(F.concat(F.lit(f"{seed}::"), F.col("stratum")), key))
    keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(64)))
    for place in (["stratum", "_part"], ["stratum"]):
        keyed = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*place).orderBy("_key", key))).where(F.col("_rank") <= F.col("take"))
    return keyed.select(*rows.columns)


def stratum_of(voted: str = "votes", curated: str = "curated") -> Column:
    """The stratum that a record's pair and split call for (SMP4): the vote, multiple choice or not, the source file; else all are one (null)."""
    source, pair = F.col("split") == "source", F.col("pair")
    return (
        F.when(source & (pair == voted), F.col("vote"))
        .when(source & F.col("is_document"), F.col("guideline_source"))
        .when(~source & (pair == curated), F.col("is_mcq").cast("string"))
    )


def few_shot(targets: DataFrame, pool: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """For each target ``k`` examples of the pool, drawn by hash without replacement (SMP5).

    ``pool`` has its examples numbered from 0 (``example``) without gaps; the draws are
    expressions and join on that number, so targets and pool are never crossed.
    """
    size = pool.count()
    k = min(k, size)
    # a start and a step that is coprime to the size never repeat within ``size`` draws
    draw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key)) + i * F.lit(_coprime(size)), F.lit(size))) if k else F.array().cast("array<bigint>")
    return targets.select(key, F.posexplode(draw).alias("shot", "example")).join(pool, "example")


def _coprime(n: int) -> int:
    from math import gcd

    return next(x for x in range(max(1, int(n * 0.618)), 2 * n + 3) if gcd(x, n) == 1)


def swap_coin(key: str, seed: int = 0) -> Column:
    """A coin for each item that falls alike in every run (SMP8)."""
    return F.substring(stable_key(seed, key), 16, 1).isin(*"13579bdf")


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times (SMP6)."""
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))


def problem_samples(rows: DataFrame, group: str, key: str, k: int = 5, order: str | None = None) -> DataFrame:
    """At most ``k`` rows of each group (SMP7): of the smallest hashes, or the first ones by ``order``.

    Spark keeps a group's first ``k`` rows before the exchange, so a large group is no burden.
    """
    w = Window.partitionBy(group).orderBy(F.col(order) if order else stable_key(0, key), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numbered(rows: DataFrame, key: str, name: str = "number", parts: int = 64) -> DataFrame:
    """``rows`` numbered from 0 without gaps, alike in every run: ranked within ``parts`` of the keys' hashes, behind the parts before."""
    keyed = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    counts = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # at most ``parts`` rows
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return keyed.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rank")).select(*rows.columns, name)


def draws(pool: DataFrame, ratio: float, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(draw, shot, and the pool's columns): int(rows * ratio) draws of ``k`` examples each (SMP5)."""
    pool = numbered(pool, key, "example")
    targets = pool.sparkSession.range(int(pool.count() * ratio)).withColumnRenamed("id", "draw")
    return few_shot(targets, pool, "draw", k, seed)


def eval_sample(examples: DataFrame, n: int | None, times: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` examples (all, if there aren't more or without n), each ``times`` times (SMP6)."""
    return repeated(examples if n is None else bottom(examples, n, key, seed), times)
