"""Writers."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import jsd_label
from granary.operators.profile import in_field_order
from granary.sources.files import exists


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with null fields kept, without the raw payload (SNK1); ``mode`` append adds to what is there (SNK2)."""
    rows.drop("raw").write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_dataset(rows: DataFrame, path: str, step: dict[str, str]) -> None:
    """Rows as Parquet, and the step in a log table beside them that earlier steps stay in (SNK3)."""
    rows.write.mode("overwrite").parquet(f"{path}/data")
    entry = rows.sparkSession.createDataFrame([(step,)], "step map<string, string>").withColumn("at", F.current_timestamp())
    entry.write.mode("append").parquet(f"{path}/processing_log")


def write_reports(found: DataFrame, path: str, benchmark: str = "benchmark") -> None:
    """A folder for each benchmark, slashes in names as underscores (SNK4)."""
    found.withColumn(benchmark, F.replace(benchmark, F.lit("/"), F.lit("_"))).write.mode("overwrite").partitionBy(benchmark).json(path)


def write_csv(rows: DataFrame, path: str, decimals: int = 6, mode: str = "overwrite") -> None:
    """CSV with a header and fixed decimals (SNK5); ``mode`` append adds a line of a summary, and a header only to a new one (SNK6).

    A null isn't written as a number.
    """
    fixed = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", c)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    header = mode != "append" or not exists(rows.sparkSession, path)
    rows.select(*fixed).write.mode(mode).option("header", header).csv(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table (SNK7). More than ``most`` rows are an error: a report isn't a place for them."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = [rows.columns, ["---"] * len(rows.columns), *([show(x) for x in r] for r in got)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def divergence_report(found: DataFrame, task_rows: DataFrame | None = None, fields: list[str] | None = None) -> str:
    """A Markdown report (SNK7): for each pair its fields, in the given order, with value, interval and, for divergences
    between 0 and 1, what the value means; then the task formats by pair and side.

    ``found`` has (pair, field, metric, value, ci_low, ci_high), with metrics jensen_shannon and wasserstein_1.
    """
    rows = found.where(F.col("metric").isin("jensen_shannon", "wasserstein_1"))
    label = F.when(F.col("metric") == "jensen_shannon", jsd_label("value")).otherwise("")
    name = F.when(F.col("metric") == "jensen_shannon", "JSD").otherwise("Wasserstein-1")
    interval = F.format_string("[%.3f, %.3f]", "ci_low", "ci_high")
    shown = rows.select("pair", F.col("field").alias("Field"), name.alias("Metric"), F.format_string("%.3f", "value").alias("Value"), interval.alias("95% CI"), label.alias("Interpretation"))
    parts = ["# Distribution shift"]
    for pair in sorted(r[0] for r in rows.select("pair").distinct().collect()):  # a few names
        parts += [f"## {pair.upper()}", markdown(in_field_order(shown.where(F.col("pair") == pair).drop("pair"), fields or [], "Field"))]
    if task_rows is not None:
        parts += ["## Task format", markdown(task_rows)]
    return "\n\n".join(parts) + "\n"


def with_missing(counts: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Cached rows and, for keys that aren't cached, new ones (SNK10, SET4)."""
    return cached.unionByName(counts.join(cached.select(key), key, "left_anti").select(*cached.columns))


def cached_ngrams(spark: SparkSession, items: DataFrame, folder: str, name: str, n: int, build) -> DataFrame:
    """An n-gram table under a key of name, size and the items' contents (SNK11, B4): built once, read afterwards."""
    content = items.agg(F.bit_xor(F.xxhash64("item_id", "text")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    key = hashlib.md5(f"{name}_{n}_{content['x']}_{content['n']}".encode()).hexdigest()
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build(items, n).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_answers(answers: DataFrame, path: str) -> None:
    """New (key, answer) rows added to a model's cache, each with its time (SNK12)."""
    answers.select("key", "answer", F.current_timestamp().alias("at")).write.mode("append").parquet(path)
