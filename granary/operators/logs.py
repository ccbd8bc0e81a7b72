"""Reports from log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import last_error, lines, log_status, model_path, training_state


def read_logs(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Whole log files with their times, the oldest first (SRC15, SRT2)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text")).orderBy("modified", "path")


def summary(logs: DataFrame, completed_only: bool = False) -> DataFrame:
    """(path, status, model, error) of each log; an error only where it has no table of results (FN26-28)."""
    rows = logs.select("path", log_status("text").alias("status"), model_path("text").alias("model"), F.when(~has_results("text"), last_error("text")).alias("error"))
    return rows.where("status = 'COMPLETED'") if completed_only else rows


def training(logs: DataFrame) -> DataFrame:
    """(path, cause, elapsed, progress, loss, epoch) of each training log (FN26, WIN8)."""
    return logs.select("path", training_state("text").alias("s")).select("path", "s.*")


# The head of a table of results, its rows (task and value), and the row of one more metric.
RESULTS_HEAD = r"(?m)^\|\s*Tasks\s*\|"
RESULTS_ROW = r"^\|\s*-?\s*([A-Za-z0-9_]+)\s*\|[^|]*\|[^|]*\|\s*\d+\|\s*\S+\s*\|[^|]*\|\s*([0-9.]+)\s*\|"
STRICT_ROW, STRICT_TASK = r"\|\s*prompt_level_strict_acc\s*\|[^|]*\|\s*([0-9.]+)\s*\|", "ifeval"


def has_results(text: str | Column) -> Column:
    return F.regexp_like(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(RESULTS_HEAD))


def results(logs: DataFrame) -> DataFrame:
    """(path, task, score) from the Markdown tables; of a repeated task the first line counts (FN29)."""
    rows = logs.select("path", F.posexplode(lines("text")).alias("line", "x"))
    task = F.when(F.col("x").rlike(RESULTS_ROW), F.regexp_extract("x", RESULTS_ROW, 1))
    score = F.when(F.col("x").rlike(RESULTS_ROW), F.regexp_extract("x", RESULTS_ROW, 2))
    strict = F.when(F.col("x").rlike(STRICT_ROW), F.regexp_extract("x", STRICT_ROW, 1))
    both = F.array(F.struct(task.alias("task"), score.alias("score")), F.struct(F.lit(STRICT_TASK).alias("task"), strict.alias("score")))
    cells = rows.select("path", "line", F.inline(both)).withColumn("score", F.col("score").try_cast("double")).where("task is not null and score is not null")
    return cells.groupBy("path", "task").agg(F.min_by("score", "line").alias("score"))


def benchmark_row(found: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean score, in per cent, of each group of tasks by file; tasks that are missing don't count (AGG31)."""
    of = [(F.avg(F.when(F.col("task").isin(*tasks), F.col("score"))) * 100).alias(name) for name, tasks in groups.items()]
    return found.groupBy("path").agg(*of)


def invalid_marks(rows: DataFrame, file: str = "path", text: str = "value") -> DataFrame:
    """How often replies are marked invalid, and per cent of the lines (AGG29)."""
    n = F.sum(F.regexp_count(F.lower(text), F.lit(r"\[invalid\]")))
    return rows.groupBy(file).agg(n.alias("n_invalid"), F.count(F.lit(1)).alias("n_lines"), (n * 100.0 / F.count(F.lit(1))).alias("pct"))


def response_lengths(samples: DataFrame, file: str = "path") -> DataFrame:
    """Mean length of the first responses of each file (AGG30); ``resps`` is an array of arrays."""
    first = F.get(F.get("resps", F.lit(0)), F.lit(0))
    return samples.groupBy(file).agg(F.avg(F.length(first)).alias("mean_length"))


def losses(states: DataFrame, text: str = "text") -> DataFrame:
    """(step, loss) from a trainer's state as JSON (SRC17)."""
    parsed = F.from_json(text, "struct<log_history: array<struct<step: long, loss: double>>>")
    return states.select(F.inline(parsed["log_history"])).where("loss is not null")


def job_id(path: str | Column) -> Column:
    """The number between two dots of a report's name; null without one (JN13)."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([0-9]+)\.", 1), F.lit(""))


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """(job, file, value): every line of every JSON-lines file below ``root`` whose folders' names end in _job, by that number (SRC16)."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    path = F.col("_metadata.file_path")
    job = F.regexp_extract(path, r"_([0-9]+)/(?:[^/]+/)*[^/]+$", 1)
    return found.select(F.nullif(job, F.lit("")).alias("job"), path.alias("path"), F.regexp_extract(path, r"(?:samples_)?([^/]*)\.jsonl$", 1).alias("file"), "value").where("job is not null")


def invalid_by_report(logs: DataFrame, results: DataFrame) -> DataFrame:
    """Invalid marks of the results' files that belong to each report, by job number (JN13, AGG29); of reports without results nothing is known."""
    reports = logs.select("path", job_id("path").alias("job"))
    counts = invalid_marks(results, "path").withColumnRenamed("path", "result").join(results.select(F.col("path").alias("result"), "job", "file").distinct(), "result")
    return reports.join(counts, "job", "left").select("path", "job", "file", "n_invalid", "n_lines", "pct")


def plot_grid(series: DataFrame, width: int = 60, height: int = 12) -> DataFrame:
    """Cells of a plot of (step, loss) with a point in them (FN30)."""
    ends = series.agg(F.min("step").alias("x0"), F.max("step").alias("x1"), F.min("loss").alias("y0"), F.max("loss").alias("y1"))
    place = lambda v, a, b, n: F.coalesce(F.least(F.floor((F.col(v) - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0)) * n), F.lit(n - 1)), F.lit(0))
    return series.join(F.broadcast(ends)).select(place("step", "x0", "x1", width).alias("x"), place("loss", "y0", "y1", height).alias("y")).distinct()  # ends is one row
