"""Readers of records, conversations and guidelines."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import schema
from granary.functions.parsing import flat_content
from granary.functions.text import has_think_block, is_mcq, strip
from granary.operators.conversations import ASSISTANT, USER, first_turn, full_text, union_all
from granary.operators.decontam import PROMPTS
from granary.operators.sampling import numbered

#: Files of a guideline folder that aren't guidelines.
SKIPPED = ("magic",)
CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, columns: str, strict: bool = True) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped (SRC1-2). A malformed line is an error, or not ``strict``, left out."""
    if strict:
        return spark.read.schema(columns).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{columns}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed texts of ``question`` of JSON lines (SRC2): lines that aren't JSON, have none, a blank one or no string are left out."""
    lines = spark.read.text(path).select(F.try_variant_get(F.try_parse_json("value"), "$.question", "variant").alias("v"))
    texts = lines.where(F.schema_of_variant("v") == "STRING").select(strip(F.variant_get("v", "$", "string")).alias("question"))
    return texts.where("question <> ''")


def rubric_examples(spark: SparkSession, paths: dict[str, str], subset: str = "all") -> DataFrame:
    """Examples with their rubrics from the local JSON lines of a subset, by name (SRC13); a KeyError if there is no such subset."""
    return read_jsonl(spark, paths[subset], schema.RUBRIC)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines that aren't JSON, with their file: what a lenient read leaves out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) <> ''")
    return lines.where(F.try_parse_json("value").isNull())


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids that an output has already; none where there is no output (SRC3)."""
    try:
        return read_jsonl(spark, path, "id string", strict=False).where("id is not null").distinct()
    except Exception as e:  # a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """(id, record as JSON) of files that hold one object keyed by id (SRC4)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, variant>")).alias("id", "v")).select("id", F.to_json("v").alias("record"))


def format_of(head: str) -> str:
    """json or jsonl from a file's first 2 KB (SRC5): an array of lines that begins with a bare brace, or a first line that isn't whole, is json."""
    import json

    lines = [x for x in head.splitlines() if x.strip()]
    if len(lines) < 2:
        return "json"
    first = lines[0].strip()
    if first == "{" or first.endswith(","):
        return "json"
    try:
        json.loads(first)
    except ValueError:
        return "json"
    return "jsonl"


def sniffed(spark: SparkSession, path: str) -> str:
    """The format by the head of the first file, read by Spark so that any store will do; unreadable counts as jsonl."""
    try:
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 2048).alias("head")).first()
        return format_of(bytes(head["head"]).decode("utf-8", "ignore"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "FileNotFound" not in str(e):
            raise
        return "jsonl"


def _json(*paths: str) -> Column:
    """The first of the paths in column ``record`` that has a text."""
    return F.coalesce(*(F.nullif(F.get_json_object("record", f"$.{p}"), F.lit("")) for p in paths))


def votes(spark: SparkSession, path: str, keyed: bool | None = None) -> DataFrame:
    """Pairwise votes as records (SRC6): lines that are flat or wrapped under their id, or one object of all; without an id they are left out."""
    if keyed if keyed is not None else sniffed(spark, path) == "json":
        rows = read_keyed(spark, path)
    else:
        lines = spark.read.text(path).where("trim(value) <> ''").withColumn("keys", F.json_object_keys("value"))
        wrapped = (F.size("keys") == 1) & F.col("value").rlike(r'^\s*\{\s*"[^"]*"\s*:\s*\{')
        inner = F.get(F.map_values(F.from_json("value", "map<string, variant>")), F.lit(0))
        rows = lines.select(F.when(wrapped, F.get("keys", F.lit(0))).alias("id"), F.when(wrapped, F.to_json(F.struct(inner.alias("v")))).otherwise(F.col("value")).alias("record"), wrapped.alias("w"))
        rows = rows.select("id", F.when(F.col("w"), F.get_json_object("record", "$.v")).otherwise(F.col("record")).alias("record"))
    rows = rows.withColumn("id", F.coalesce(_json("contribution_id", "id"), "id")).where("id is not null")
    user = F.when(F.get_json_object("record", "$.user").startswith("{"), F.get_json_object("record", "$.user.value"))
    out = rows.select("id", _json("question", "prompt").alias("question"), _json("firstAnswer").alias("first_answer"), _json("secondAnswer").alias("second_answer"), _json("vote").alias("vote"), _json("country").alias("country"), _json("organization_name").alias("organization"), _json("workingGroup_name").alias("working_group"), user.alias("rater"), _json("parentContribution.value").alias("parent"), F.col("record").alias("raw"))
    return out.withColumn("full_text", full_text("question", "first_answer", "second_answer"))


QUESTION_KEYS, ANSWER_KEYS = ("question", "instruction", "prompt", "input"), ("answer", "output", "response", "completion")
_TURNS = "array<struct<`from`: string, value: string>>"


def conversations(spark: SparkSession, path: str, pair: str, split: str, prefix: str) -> DataFrame:
    """Conversation files as corpus records (SRC7): the first turns, else the top-level keys; ids by the record, else by
    the hash of question and answer, since rows have no order: the same pair has the same id in every run."""
    text = ", ".join(f"{x} string" for x in (*QUESTION_KEYS, *ANSWER_KEYS))
    rows = read_jsonl(spark, path, f"id string, question_id string, conversation_id string, conversations {_TURNS}, {text}, label_letter string, parse_failed boolean", strict=False)
    filled = lambda keys: (F.nullif(F.col(k), F.lit("")) for k in keys)
    rows = rows.withColumn("q", F.coalesce(first_turn("conversations", USER), *filled(QUESTION_KEYS))).withColumn("a", F.coalesce(first_turn("conversations", ASSISTANT), *filled(ANSWER_KEYS)))
    named = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(F.col("question_id"), F.lit("")), F.nullif(F.col("conversation_id"), F.lit("")), F.sha2(F.concat_ws("\0", "q", "a"), 256))
    return rows.select(
        F.concat(F.lit(f"{prefix}_"), named).alias("id"),
        F.lit(pair).alias("pair"),
        F.lit(split).alias("split"),
        F.col("q").alias("question"),
        F.col("a").alias("answer"),
        full_text("q", "a").alias("full_text"),
        is_mcq("q").alias("is_mcq"),
        (F.col("q").isNotNull() & F.col("a").isNotNull()).alias("is_paired"),
        F.lit(False).alias("is_document"),
        has_think_block("a").alias("has_think_block"),
        F.coalesce("parse_failed", F.lit(False)).alias("parse_failed"),
        F.col("label_letter").alias("mcq_label"),
    )


def guidelines(spark: SparkSession, path: str) -> DataFrame:
    """A folder of guideline files as corpus records (SRC8-9): the body is the first of four fields that has text, its name the
    variant (content by its kind). Records without an id have one by their hash."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select(F.lower(F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1)).alias("source"), F.col("value").alias("record"))
    rows = rows.where(F.trim("record") != "").where(~F.col("source").isin(*SKIPPED))
    bodies = ("clean_text", "text", "content", "raw_text")
    rows = rows.withColumn("content", flat_content(F.get_json_object("record", "$.content"))).withColumn("kind", F.when(F.try_variant_get(F.try_parse_json("record"), "$.content", "map<string, variant>").isNotNull(), "content_dict").otherwise("content_str"))
    body = {b: F.nullif(strip("content" if b == "content" else _json(b)), F.lit("")) for b in bodies}
    variant = F.coalesce(*(F.when(c.isNotNull(), F.col("kind") if b == "content" else F.lit(b)) for b, c in body.items()), F.lit("empty"))
    rows = rows.select("source", "record", _json("id").alias("id"), strip(_json("title", "name")).alias("title"), _json("url", "link").alias("url"), F.coalesce(*body.values()).alias("body"), variant.alias("variant"))
    return rows.select(
        F.concat(F.lit("guidelines_src_"), F.coalesce("id", F.concat_ws("_", "source", F.md5(F.coalesce("record", F.lit("")))))).alias("id"),
        F.lit("guidelines").alias("pair"),
        F.lit("source").alias("split"),
        full_text("title", "body").alias("full_text"),
        F.lit(True).alias("is_document"),
        (F.col("variant") == "empty").alias("parse_failed"),
        F.col("source").alias("guideline_source"),
        "url",
        "variant",
    )


def dataset(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """A table from a Parquet folder, or from JSON lines if the name says so (SRC11-12); JSON needs a schema."""
    if path.endswith((".json", ".jsonl")):
        if columns is None:
            raise ValueError("JSON needs a schema")
        return read_jsonl(spark, path, columns)
    return spark.read.parquet(path)


def splits(spark: SparkSession, paths: dict[str, str], columns: str | None = None, name: str = "split") -> DataFrame:
    """Datasets by split as one table with a column ``split`` (SRC11)."""
    return union_all(*(dataset(spark, path, columns).withColumn(name, F.lit(x)) for x, path in paths.items()))


def benchmarks(spark: SparkSession, paths: dict[str, tuple[str, str]], columns: str | None = None) -> DataFrame:
    """(benchmark, item_id, text) of local benchmarks, by name: path and format (SRC12, PRJ8); items are numbered alike in every run."""
    parts = []
    for name, (path, form) in paths.items():
        prompts = dataset(spark, path, columns).select(PROMPTS[form]().alias("text"))
        parts.append(numbered(prompts, "text", "item_id").select(F.lit(name).alias("benchmark"), "item_id", "text"))
    return union_all(*parts)


LOADERS: dict[tuple[str, str], Callable[..., DataFrame]] = {
    ("votes", "source"): votes,
    ("votes", "synthetic"): lambda spark, path: conversations(spark, path, "votes", "synthetic", "votes_syn"),
    ("curated", "source"): lambda spark, path: conversations(spark, path, "curated", "source", "curated_src"),
    ("curated", "synthetic"): lambda spark, path: conversations(spark, path, "curated", "synthetic", "curated_syn"),
    ("guidelines", "source"): guidelines,
    ("guidelines", "synthetic"): lambda spark, path: conversations(spark, path, "guidelines", "synthetic", "guidelines_syn"),
}


def load(spark: SparkSession, pair: str, split: str, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """By pair, or another name for it in ``aliases``, and split; a KeyError if there is no such loader (SRC10)."""
    return LOADERS[(aliases or {}).get(pair, pair), split](spark, path)


def load_all(spark: SparkSession, paths: dict[tuple[str, str], str]) -> tuple[dict[tuple[str, str], DataFrame], dict[tuple[str, str], str]]:
    """All groups that can be read, and what is wrong with the others (SRC18)."""
    found, wrong = {}, {}
    for group, path in paths.items():
        try:
            found[group] = load(spark, *group, path)
        except Exception as e:  # reported, the other groups go on
            wrong[group] = str(e).splitlines()[0]
    return found, wrong


def config(path: str | None, override: dict[str, Any] | None = None, root: str = ".") -> dict[str, str]:
    """Dataset paths from a YAML file, arguments first; relative ones from ``root`` (SRC14)."""
    values: dict[str, Any] = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            values = (yaml.safe_load(f) or {}).get("paths", {})
    values |= {k: v for k, v in (override or {}).items() if v is not None}
    return {k: v if os.path.isabs(v) or "://" in v else os.path.join(root, v) for k, v in values.items()}
