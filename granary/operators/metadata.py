"""Annotations by a model: prompts out, parsed tags in, a batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import metadata
from granary.operators.conversations import document_body, messages, qa_body


def tag_prompts(records: DataFrame, system_qa: str, system_document: str) -> DataFrame:
    """(id, messages) for each record: documents by head and tail, pairs by question and answer."""
    body = F.when(F.col("is_document"), document_body("full_text")).otherwise(qa_body("question", "answer"))
    return records.select("id", messages(F.when(F.col("is_document"), system_document).otherwise(system_qa), body).alias("messages"))


def tagged(records: DataFrame, replies: DataFrame) -> DataFrame:
    """Records with their parsed annotation, without the raw payload; of a missing reply it isn't parsed."""
    rows = records.drop("raw").join(replies.select("id", "reply"), "id", "left")
    return rows.withColumn("analysis_metadata", metadata("reply", "is_document")).drop("reply")


def usable(field: str) -> Column:
    """Parsed rows in which the field is there (FLT10)."""
    return F.col("analysis_metadata._parse_ok") & F.col(f"analysis_metadata.{field}").isNotNull()


def parse_rate(rows: DataFrame, *group: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if("analysis_metadata._parse_ok").alias("n_ok"))
