"""Profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import has_think_block, is_mcq, n_tokens


def profile(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Totals, empty texts, repeated ids, and tokens (mean over texts with any, to a tenth; most) of each group (AGG1, SET5)."""
    rows = rows.select(group, key, n_tokens(text).alias("n"))
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("n") == 0).alias("empty"),
        (F.count(key) - F.countDistinct(key)).alias("dup_ids"),
        F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 1).alias("avg_tokens"),
        F.max("n").alias("max_tokens"),
    )


def top_counts(rows: DataFrame, group: str, value: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each group as ``value=n;...``; ties by value (AGG2)."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("r") <= k)
    entry = F.struct("r", F.concat_ws("=", F.col(value), F.col("n").cast("string")).alias("s"))
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]), ";").alias("top"))


def composition(rows: DataFrame, outer: str, inner: str, text: str) -> DataFrame:
    """Records and tokens by both columns, by the outer one, and in all (AGG3)."""
    return rows.select(outer, inner, n_tokens(text).alias("n")).rollup(outer, inner).agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("tokens"))


def task_format(rows: DataFrame, *group: str) -> DataFrame:
    """Share (in per cent) of question-answer pairs, multiple choice, documents and thinking blocks; median tokens of
    question, answer and full text (AGG11). Without a column is_document no row is one."""
    document = F.coalesce("is_document", F.lit(False)) if "is_document" in rows.columns else F.lit(False)
    flags = [F.col("question").isNotNull() & F.col("answer").isNotNull(), is_mcq("question"), document, has_think_block("answer")]
    rows = rows.select(*group, *flags, *map(n_tokens, ("question", "answer", "full_text"))).toDF(*group, "paired", "mcq", "document", "think", "q", "a", "full")
    share = lambda x: (F.avg(F.col(x).cast("int")) * 100).alias(f"pct_{x}")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *map(share, ("paired", "mcq", "document", "think")), *(F.median(x).alias(f"median_{x}") for x in ("q", "a", "full")))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Count and per cent of each value (AGG12, WIN5)."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / rows.agg(F.count(F.lit(1))).scalar())


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 5) -> DataFrame:
    """Share of the rows in each of ``bins`` equal parts (AGG14)."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("bin")
    counts = rows.where(F.col(value).between(low, high)).groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / counts.agg(F.sum("n")).scalar())


def first_of(rows: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The first row, by ``order``, of each key (WIN1). One aggregation with partial results, so a frequent key is no burden."""
    key = F.col(key) if isinstance(key, str) else key
    every = F.struct(F.col(order).alias("_order"), *rows.columns)
    return rows.groupBy(key.alias("_key")).agg(F.min_by(every, F.col(order)).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in rows.columns))


def pair_key(parent: str, question: str, first: str, second: str) -> Column:
    """A parent's id, else the hash of the three texts (PRJ19)."""
    text = F.concat(*(F.coalesce(F.col(x), F.lit("")) for x in (question, first, second)))
    return F.coalesce(F.nullif(F.col(parent), F.lit("")), F.md5(text))


def grouped_by_pair(rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each pair its first row and how many rows it has; the rows themselves stay a table (AGG33)."""
    return first_of(rows, key, order).join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), key)


def is_valid(strict: bool = False) -> Column:
    """Every record, or with ``strict`` those parsed, of 40 characters or more, with a real id (FLT3)."""
    if not strict:
        return F.lit(True)
    return ~F.col("parse_failed") & (F.length("full_text") >= 40) & ~F.col("id").endswith("_None")


def is_complete() -> Column:
    """A question with its answer (FLT4)."""
    return F.col("question").isNotNull() & F.col("answer").isNotNull()


def is_voted() -> Column:
    """A valid vote on two answers (FLT5)."""
    return F.col("vote").isin("1", "2", "12") & (F.col("first_answer") != "") & (F.col("second_answer") != "")


def has_prompt() -> Column:
    return F.coalesce(F.nullif(F.col("prompt"), F.lit("")), F.nullif(F.col("question"), F.lit(""))).isNotNull()


def frequent(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Keys of ``least`` rows or more (FLT12)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def shown_categories(shares: DataFrame, most: int = 12, least: float = 0.005) -> DataFrame:
    """All categories up to ``most``; of more, those of a share of ``least`` in either arm, filled up to ``most`` by size (FLT13)."""
    top = F.greatest("prop_source", "prop_synthetic")
    first = shares.orderBy(F.desc(top), "category").limit(most).select("category")  # so few rows for each task
    return shares.where(top >= least).unionByName(shares.where(top < least).join(F.broadcast(first), "category", "left_semi"))


def by_source_share(shares: DataFrame) -> DataFrame:
    """Categories in the order of a figure: the largest share of the source first (SRT4)."""
    return shares.orderBy(F.desc("prop_source"), "category")


def in_field_order(rows: DataFrame, fields: list[str], column: str = "field") -> DataFrame:
    """Rows of a report in the order of ``fields``, others last (SRT3)."""
    place = F.array_position(F.array(*map(F.lit, fields)), F.col(column))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(fields) + 1), column)


def routed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete pairs with a label and those without; an error if either is empty (FLT14)."""
    done = rows.where(is_complete())
    labelled, open_ = done.where("label_letter is not null and label_letter <> ''"), done.where("label_letter is null or label_letter = ''")
    if labelled.isEmpty() or open_.isEmpty():
        raise ValueError("labelled and unlabelled pairs are both needed")
    return labelled, open_
