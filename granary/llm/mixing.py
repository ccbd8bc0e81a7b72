"""Mixing sources to target weights: a low-discrepancy schedule of blocks, of equal words within a source."""

from __future__ import annotations

import math
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table

#: Weights that the sources take in turn, and the share of all words that is mixed.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
#: The golden ratio's point i, in steps of 2^-32: frac(i * 0.618...) = (i * GOLDEN mod 2^32) / 2^32.
GOLDEN = 2654435769
#: Slots that a schedule aims at, and the bounds of a block's words.
SLOTS, LEAST_BLOCK, MOST_BLOCK = 1 << 17, 4, 1 << 16
#: Slots that a source has at least, by smaller blocks, unless these would be below LEAST_BLOCK.
LEAST_SLOTS = 128
#: Columns of the table of sources.
LANES = {"_lane": pa.int32(), "source": pa.string(), "words": pa.int64(), "target": pa.float64(), "blocks": pa.int64(), "_buckets": pa.int64(), "_block": pa.int64(), "_goal": pa.int64(), "_slots": pa.int64()}
#: Slots that are ranked together, and documents of a source that are put in order together (about).
CHUNK, BUCKET = 1 << 14, 1 << 12


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Words to take from each source: ``share`` of all words by weight, at most ``most`` times a source's words.

    Sources are ordered by code point, null last, and take the weights in turn. What a source
    can't take is shared again by weight among the others, until none is above its limit.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: float(most * n) for s, n in order}
    out: dict[str | None, float] = {}
    rest, free = share * sum(n for _, n in order), [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total >= limit[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in free}
        out |= {s: limit[s] for s in full}
        rest -= sum(limit[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (white-space words; null text: 0) and an order key that shuffles each source the same way in every run."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("size"),
        F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), text).alias("_at"),
    )


def slots_for(words: int, goal: int, block: int) -> int:
    """Slots that take ``goal`` words of a source of ``words``, pass after pass; each pass ends with what is left of the source."""
    passes, rest = divmod(goal, words) if words else (0, 0)
    return passes * -(-words // block) + -(-rest // block)


def plan(docs: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their place in their source, the sources, and the schedule.

    Places: doc_id, source, size, source_size, target, _start (words before it in its source's
    shuffled order), _lane. Sources: _lane, source, words, target, blocks. Schedule: slot, _lane,
    block and words, in the order of the mixture; a block is ``_block`` words of its source's
    shuffled documents on end, the last one of a source may be shorter. A slot takes the first
    ``words`` words of its block: all of them, but for the slot that fills its source's target.

    The sources' sizes (one row a source) go to the driver; documents, blocks and slots don't.
    """
    spark = docs.sparkSession
    base = stored(sized(docs), "mix")
    total = base.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    goal = targets([(r["source"], r["words"]) for r in total], share=share)
    mixed = sum(goal.values())
    block = max(LEAST_BLOCK, min(MOST_BLOCK, math.ceil(mixed / SLOTS))) if mixed else LEAST_BLOCK
    lanes = []
    for lane, r in enumerate(sorted(total, key=lambda r: (r["source"] is None, r["source"] or ""))):
        target, words = float(goal[r["source"]]), round(goal[r["source"]])
        own = max(LEAST_BLOCK, min(block, words // LEAST_SLOTS))
        lanes.append((lane, r["source"], r["words"], target, -(-r["words"] // own), max(1, r["rows"] // BUCKET), own, words, slots_for(r["words"], words, own)))
    # as Arrow: rows of a Python list would be made by Python workers of their own, a daemon and one for each core of an executor
    sources = spark.createDataFrame(pa.Table.from_arrays([pa.array([x[i] for x in lanes], kind) for i, kind in enumerate(LANES.values())], names=list(LANES)))

    # the words before each bucket of a source, then before each document of a bucket
    keyed = base.join(F.broadcast(sources.select("_lane", "_buckets", "_block", "words", "target", F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s")))
    keyed = keyed.withColumn("_bucket", F.expr("cast(shiftrightunsigned(_at, 33) * _buckets >> 31 as long)"))
    sums = keyed.groupBy("_lane", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_lane").orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("_lane", "_bucket").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.join(sums, ["_lane", "_bucket"])
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "_lane", "_start", "_block")
    )

    # slots: golden-ratio points through the cumulative slots, ranked by source chunk after chunk
    ends = list(accumulate((x[-1] for x in lanes), initial=0))
    edges = [round(x / ends[-1] * 2**32) if ends[-1] else 0 for x in ends]
    slots = spark.range(ends[-1]).select(F.col("id").alias("slot"), ((F.col("id") % 2**32) * GOLDEN % 2**32).alias("_point"), F.floor(F.col("id") / CHUNK).alias("_chunk"))
    bounds = F.array(*(F.struct(F.lit(x[0]).alias("lane"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")) for x, low, high in zip(lanes, edges, edges[1:], strict=False))) if lanes else F.lit(None).cast("array<struct<lane:int,low:long,high:long>>")
    slots = slots.withColumn("_lane", F.filter(bounds, lambda b: (b["low"] <= F.col("_point")) & (F.col("_point") < b["high"]))[0]["lane"])
    counts = slots.groupBy("_chunk", "_lane").agg(F.count(F.lit(1)).alias("_n"))
    given = counts.groupBy("_lane").agg(F.sum("_n").alias("_given"))
    counts = counts.withColumn("_earlier", F.sum("_n").over(Window.partitionBy("_lane").orderBy("_chunk")) - F.col("_n")).drop("_n")
    ranked = slots.withColumn("_rank", F.row_number().over(Window.partitionBy("_chunk", "_lane").orderBy("slot")) - 1).join(counts, ["_chunk", "_lane"])
    ranked = ranked.select("slot", "_lane", (F.col("_earlier") + F.col("_rank")).alias("_nth"))
    # what the points leave open of a source comes after them, the sources in turn
    late = sources.join(given, "_lane", "left").withColumn("_given", F.coalesce("_given", F.lit(0))).where("_given < _slots")
    late = late.select("_lane", "_given", F.explode(F.expr("sequence(_given, _slots - 1)")).alias("_nth"))
    late = late.select((ends[-1] + (F.col("_nth") - F.col("_given")) * len(lanes) + F.col("_lane")).alias("slot"), "_lane", "_nth")
    schedule = (
        ranked.unionAll(late)
        .join(F.broadcast(sources.select("_lane", "blocks", "_block", "_goal", "_slots", F.col("words").alias("_all"))), "_lane")
        .where("_nth < _slots")
        .withColumn("block", F.col("_nth") % F.col("blocks"))
        .withColumn("_at", F.expr("block * _block"))
        .select("slot", "_lane", "block", F.expr("least(_block, _all - _at, _goal - (_nth div blocks) * _all - _at)").alias("words"))
    )
    return placed, sources, schedule


def mix(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mixture takes, repeats counted) of every row.

    Slot i of the schedule goes to the source in whose part of the cumulative slots the
    golden-ratio point of i falls; the source's n-th slot takes its block n, from the start
    again after the last. A source has as many slots as its target needs, the last one cut to
    size: those that the points don't give it come at the end, and points beyond them are left
    out. So every source gives its target to the word (rounded), however large the corpus is. A
    block of a source comes at most twice, so no document gives more than twice its words. Null and empty texts have size 0 and give nothing; null sources are
    one source, the last; repeated rows are documents of their own; other columns are ignored;
    an empty table gives no rows. The order within a source depends on doc_id and text
    alone, so reruns agree.
    """
    placed, _, schedule = plan(docs, share)
    # how often each block is taken, and how much of it the last time; then what each document has in each of its blocks
    times = schedule.groupBy("_lane", "block").agg(F.count(F.lit(1)).alias("_times"), F.min("words").alias("_last"))
    parts = placed.where("size > 0").select("*", F.explode(F.expr("sequence(_start div _block, (_start + size - 1) div _block)")).alias("block"))
    parts = parts.withColumn("_from", F.greatest(F.col("_start") - F.col("block") * F.col("_block"), F.lit(0)))
    parts = parts.withColumn("_to", F.least(F.col("_start") + F.col("size") - F.col("block") * F.col("_block"), F.col("_block")))
    part = F.expr("(_times - 1) * (_to - _from) + greatest(least(_to, _last) - _from, 0)")
    keys = ["doc_id", "size", "source_size", "target", "_lane", "_start"]
    taken = parts.select(*keys, "block", "_from", "_to").join(times, ["_lane", "block"], "left").groupBy(*keys).agg(F.sum(F.coalesce(part, F.lit(0))).alias("taken"))
    empty = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken").unionAll(empty)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
