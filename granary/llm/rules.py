"""Quality rules: rules vote or abstain, and expectation-maximisation weighs their votes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import id_and_text, stored, table

#: Fixed values of the base rules: least words, and the most of 100 words that may lie in repeated windows.
LEAST_WORDS, MOST_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A rule votes bad where its measure is below the first or above the fourth bound, good between the
#: second and the third, and abstains elsewhere.
RULES = {
    "symbol_share": (0, 0, 0.02, 0.1),
    "repeat_share": (0, 0, 0.1, 0.3),
    "dup_line_share": (0, 0, 0.05, 0.3),
    "word_length": (2.5, 3.0, 9.0, 12.0),
    "upper_share": (0, 0, 0.15, 0.4),
    "exclaim_share": (0, 0, 0.05, 0.2),
    "stop_share": (0.005, 0.02, 0.5, 0.9),
    "distinct_share": (0.15, 0.3, 1.0, 1.0),
}
#: What is known before any vote: the share of good texts, and the share of good votes on good texts (a rule is written so
#: that it seldom finds fault with them), each with its weight as a part of the number of texts. Where only one or two
#: rules tell bad texts apart, the votes alone don't settle the classes.
SHARE_PRIOR, PRECISION_PRIOR = (0.9, 1.0), (0.99, 0.3)


def without(text: str, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, in built-in functions only.

    The windows of three words are compared by 64-bit hashes: two different windows of a text
    share one with a probability of about n * n / 2^64. Everything is linear in the words but
    for two sorts of them.
    """
    rows = id_and_text(docs).withColumn("words", F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        without("text", SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        without("text", UPPER).cast("long").alias("n_upper"),
        without("text", "!").cast("long").alias("n_exclaim"),
        without("text", ".").cast("long").alias("n_stops"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    windows = F.when(F.col("n_words") > 3, F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"))
    rows = rows.withColumn("windows", windows).drop("words")
    # only where a window comes again: windows in order with their places, then the places of those equal to a neighbour
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("windows", F.when(again, F.expr("array_sort(transform(windows, (x, i) -> struct(x, i)))")))
    at = F.expr("array_sort(filter(transform(windows, (x, j) -> if(x.x <=> get(windows, j - 1).x or x.x <=> get(windows, j + 1).x, x.i, null)), i -> i is not null))")
    rows = rows.withColumn("at", at).drop("windows")
    covered = F.expr("aggregate(transform(at, (i, j) -> least(3, coalesce(get(at, j + 1) - i, 3))), 0L, (s, x) -> s + x)")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def votes(rows: DataFrame) -> DataFrame:
    """``rows`` with a column for each rule: 1 good, 0 bad, null abstains."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    measure = {
        "symbol_share": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines")),
        "word_length": F.col("word_chars") / words,
        "upper_share": F.col("n_upper") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
        "exclaim_share": F.col("n_exclaim") / words,
        "stop_share": F.col("n_stops") / words,
        # short texts say little about repetition, long ones repeat words anyway
        "distinct_share": F.when(F.col("n_words") >= LEAST_WORDS, F.col("n_distinct") / F.least(words, F.lit(2000))),
    }
    out = {}
    for name, (low, from_, to, high) in RULES.items():
        x = measure[name]
        out[f"v_{name}"] = F.when((x < low) | (x > high), 0).when((x >= from_) & (x <= to), 1)
    return rows.withColumns(out)


def expectation_maximisation(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 300, share_prior: tuple[float, float] = (0.5, 0.0), precision_prior: tuple[float, float] = (0.5, 0.0)) -> tuple[float, list[tuple[float, float]]]:
    """Share of good texts, and each rule's chance of a good vote on good texts and of a bad vote on bad ones.

    ``patterns`` are vote patterns with their numbers of texts; votes are taken as independent
    given the truth, an abstention as no vote. It starts with a text as bad that has any bad
    vote, and ends when the chances no longer move. The priors (mean, weight as a part of the
    number of texts) count as so many more texts and votes.
    """
    mass = sum(n for _, n in patterns)
    (likely, weight), (precise, trust) = share_prior, precision_prior
    extra = mass * weight
    rules = len(patterns[0][0]) if patterns else len(RULES)
    bad_votes = [sum(v == 0 for v in p) for p, _ in patterns]
    good = [0.95 if not b else 0.1 for b in bad_votes]
    share, accuracies = 0.5, [(0.5, 0.5)] * rules
    for _ in range(rounds if patterns else 0):
        new_share = min(0.99, max(0.01, (sum(g * n for g, (_, n) in zip(good, patterns, strict=True)) + extra * likely + 1) / (mass + extra + 2)))
        new = []
        for j in range(rules):
            counts = [[1.0, 1.0], [1.0 + mass * trust * (1 - precise), 1.0 + mass * trust * precise]]  # by truth: (bad votes, good votes), smoothed
            for g, (p, n) in zip(good, patterns, strict=True):
                if p[j] is not None:
                    counts[1][p[j]] += g * n
                    counts[0][p[j]] += (1 - g) * n
            new.append((counts[1][1] / sum(counts[1]), counts[0][0] / sum(counts[0])))
        moved = max([abs(new_share - share), *(abs(a - b) for x, y in zip(new, accuracies, strict=True) for a, b in zip(x, y, strict=True))])
        share, accuracies = new_share, new
        good = [1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds(p, share, accuracies))))) for p, _ in patterns]
        if moved < 1e-6:
            break
    return share, accuracies


def log_odds(pattern: tuple[int | None, ...], share: float, accuracies: list[tuple[float, float]]) -> float:
    out = math.log(share / (1 - share))
    for v, (on_good, on_bad) in zip(pattern, accuracies, strict=True):
        if v is not None:
            out += math.log(on_good / (1 - on_bad)) if v else math.log((1 - on_good) / on_bad)
    return out


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and p_good (posterior probability of good quality) of every row.

    The vote patterns of all texts that no base rule fails, those whose verdict is open, are
    counted on the executors; the driver gets a row for each pattern, at most 3 ^ (number of
    rules). Texts that fail are bad in ways of their own (too short, all repetition), and would
    become the model's bad class. No two rules measure the same characters, since votes count as
    independent. A text is kept if no base rule fails and p_good is a half or more. Null, empty and blank texts have no words and fail; repeated rows and null ids stay;
    other columns are ignored; an empty table gives no rows.
    """
    rows = stored(votes(measured(docs)), "measured")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    names = [f"v_{x}" for x in RULES]
    patterns = sorted(((tuple(r[x] for x in names), r["n"]) for r in rows.where(~failed).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()), key=str)
    share, accuracies = expectation_maximisation(patterns, share_prior=SHARE_PRIOR, precision_prior=PRECISION_PRIOR)
    odds = F.lit(math.log(share / (1 - share)))
    for name, (on_good, on_bad) in zip(names, accuracies, strict=True):
        odds = odds + F.when(F.col(name) == 1, math.log(on_good / (1 - on_bad))).when(F.col(name) == 0, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    p = 1 / (1 + F.exp(-odds))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (p >= 0.5)).alias("kept"), p.alias("p_good"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
