"""Pairwise judging and agreement."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import strip
from granary.functions.vocabulary import CRITERIA

WINNERS = ("Model 1", "Model 2", "Tie")


def scores_of(text: str, which: int) -> Column:
    """Map of criterion to a model's score, 1 to 5; null unless the reply has two scores of the criterion (FN15)."""
    entries = []
    for name in CRITERIA:
        hits = F.regexp_extract_all(F.col(text), F.lit(rf"(?i){re.escape(name).replace(chr(92) + ' ', ' ').replace(chr(92) + '&', '&')}:\s*([1-5])"), F.lit(1))
        entries += [F.lit(name), F.when(F.size(hits) >= 2, F.get(hits, F.lit(which - 1)).cast("int"))]
    return F.create_map(*entries)


def winner_of(text: str) -> Column:
    found = F.regexp_extract(F.col(text), r"(?i)Winner:\s*(Model 1|Model 2|Tie)", 1)
    return F.when(found != "", F.initcap(found)).otherwise("Unknown")


def parsed(text: str) -> Column:
    """A judge's reply as scores of both models, reasoning and winner (FN15). The reasoning begins at the first "reasoning:" in any case, a criterion's included."""
    reasoning = strip(F.regexp_extract(F.col(text), r"(?is)Reasoning:\s*(.*?)\nWinner:", 1))
    return F.struct(scores_of(text, 1).alias("model_1_scores"), scores_of(text, 2).alias("model_2_scores"), reasoning.alias("reasoning"), winner_of(text).alias("winner"))


def is_valid(text: str) -> Column:
    return winner_of(text).isin(*WINNERS)


def shown(prompt: str, first: str, second: str, swap: str) -> Column:
    """The user's message to the judge: the answers stand in swapped order where ``swap`` (PRJ11)."""
    one, two = (F.when(F.col(swap), F.col(a)).otherwise(F.col(b)) for a, b in ((second, first), (first, second)))
    return F.concat(F.lit("Prompt:\n"), F.col(prompt), F.lit("\n\nModel 1:\n"), one, F.lit("\n\nModel 2:\n"), two)


def unswapped(winner: str, swap: str) -> Column:
    """The winner in the answers' own order (PRJ16)."""
    w = F.col(winner)
    return F.when(F.col(swap) & (w == "Model 1"), "Model 2").when(F.col(swap) & (w == "Model 2"), "Model 1").otherwise(w)


def unswapped_scores(reply: str, swap: str) -> Column:
    """(first, second): the scores of a parsed reply in the answers' own order (PRJ16)."""
    one, two, turned = F.col(f"{reply}.model_1_scores"), F.col(f"{reply}.model_2_scores"), F.col(swap)
    return F.struct(F.when(turned, two).otherwise(one).alias("first"), F.when(turned, one).otherwise(two).alias("second"))


def gathered(key: str, items: DataFrame, *tables: DataFrame) -> DataFrame:
    """Items with what each table (answers, a judge's replies, coins) says of them, joined by the items' id (JN7)."""
    return reduce(lambda a, b: a.join(b, key), tables, items)


def judge_rows(items: DataFrame, replies: DataFrame, key: str, reply: str, swap: str) -> DataFrame:
    """(key, judge_vote, first, second) of each item: the judge's replies, parsed and put in the answers' own order; a null vote where it isn't valid."""
    rows = gathered(key, items.select(key, swap), replies.select(key, parsed(reply).alias("_reply")))
    vote = vote_code(unswapped("_reply.winner", swap))
    return rows.select(key, vote.alias("judge_vote"), unswapped_scores("_reply", swap).alias("_scores")).select(key, "judge_vote", "_scores.*")


def vote_code(winner: str | Column) -> Column:
    w = F.col(winner) if isinstance(winner, str) else winner
    return F.when(w == "Model 1", "1").when(w == "Model 2", "2").when(w == "Tie", "12")


def win_rates(rows: DataFrame, winner: str, *group: str) -> DataFrame:
    """Counts, rates over decided rows, net and adjusted rates of the second model (AGG15-16, B8)."""
    w = F.col(winner)
    decided = F.count_if(w.isin(*WINNERS))
    of = lambda x: F.count_if(w == x)
    rate = lambda n: F.try_divide(n, decided)
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_total"),
        decided.alias("n_decided"),
        of("Model 1").alias("n_1"),
        of("Model 2").alias("n_2"),
        of("Tie").alias("n_tie"),
        rate(of("Model 2")).alias("win_2"),
        rate(of("Model 2") - of("Model 1")).alias("net"),
        rate(of("Model 2") + 0.5 * of("Tie")).alias("adjusted"),
    )


def likert(rows: DataFrame, item: str, first: str, second: str) -> DataFrame:
    """Mean score of each model and mean difference, by criterion, over items with both (AGG17, AGG23)."""
    pairs = rows.select(item, F.explode(first).alias("criterion", "a"), F.col(second).alias("_b")).withColumn("b", F.element_at("_b", F.col("criterion")))
    return pairs.where("a is not null and b is not null").groupBy("criterion").agg(F.avg("a").alias("mean_1"), F.avg("b").alias("mean_2"), F.avg(F.col("b") - F.col("a")).alias("diff"), F.count(F.lit(1)).alias("n"))


def overall_delta(rows: DataFrame, item: str, first: str, second: str) -> DataFrame:
    """Mean over items of the item's mean difference over criteria (AGG18); paired by item, not by position (B9)."""
    pairs = rows.select(item, F.explode(first).alias("criterion", "a"), F.col(second).alias("_b")).withColumn("b", F.element_at("_b", F.col("criterion")))
    return pairs.where("a is not null and b is not null").groupBy(item).agg(F.avg(F.col("b") - F.col("a")).alias("d")).agg(F.avg("d").alias("delta"))


def verdict(n1: Column, n2: Column, n12: Column) -> Column:
    """The most frequent vote; 12 if several share the first place; null without votes (AGG19)."""
    best = F.greatest(n1, n2, n12)
    places = sum(((x == best).cast("int") for x in (n1, n2, n12)), F.lit(0))
    return F.when(best == 0, None).when(places > 1, "12").when(n1 == best, "1").when(n2 == best, "2").otherwise("12")


def _counts(vote: str) -> list[Column]:
    return [F.count_if(F.col(vote) == x) for x in ("1", "2", "12")]


def panel(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """One verdict for each item (AGG19)."""
    n1, n2, n12 = _counts(vote)
    return votes.groupBy(item).agg(n1.alias("n1"), n2.alias("n2"), n12.alias("n12")).select(item, verdict(F.col("n1"), F.col("n2"), F.col("n12")).alias("verdict"))


def kappa(rows: DataFrame, a: str, b: str, group: list[str], ties: bool = True) -> DataFrame:
    """Agreement and Cohen's kappa by group; 1 where chance agreement is complete (AGG20)."""
    if not ties:
        rows = rows.where((F.col(a) != "12") & (F.col(b) != "12"))
    chance = sum((F.avg((F.col(a) == c).cast("double")) * F.avg((F.col(b) == c).cast("double")) for c in ("1", "2", "12")), F.lit(0.0))
    out = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), chance.alias("chance"))
    return out.withColumn("kappa", F.when(F.col("chance") >= 1, 1.0).otherwise((F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))))


def against_others(votes: DataFrame, item: str, rater: str, vote: str) -> DataFrame:
    """Each vote beside the verdict of all other raters of the item: counts less one's own, no self join (JN9, WIN4)."""
    counts = votes.groupBy(item).agg(*(c.alias(f"_n{i}") for i, c in enumerate(_counts(vote))))
    own = [(F.col(vote) == x).cast("long") for x in ("1", "2", "12")]
    rows = votes.join(counts, item)
    return rows.select(item, rater, vote, verdict(*(F.col(f"_n{i}") - o for i, o in enumerate(own))).alias("others")).where("others is not null")


def rater_kappas(votes: DataFrame, item: str, rater: str, vote: str, least: int = 1, ties: bool = True) -> DataFrame:
    """Every rater's kappa against the others, of ``least`` items or more (AGG21, FLT12); without ties, of as many that are none as well."""
    rows = against_others(votes, item, rater, vote)
    found = kappa(rows, vote, "others", [rater], ties).where(F.col("n") >= least)
    if ties:
        return found
    return found.join(rows.groupBy(rater).agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") >= least).select(rater), rater)


def judge_against_panel(votes: DataFrame, judged: DataFrame, item: str, vote: str, judge_vote: str, ties: bool = True) -> DataFrame:
    """A judge's agreement and kappa against the whole panel of each item with two votes or more (AGG21, JN8)."""
    several = votes.groupBy(item).agg(*(c.alias(f"n{i}") for i, c in enumerate(_counts(vote)))).where("n0 + n1 + n2 >= 2")
    rows = several.select(item, verdict(F.col("n0"), F.col("n1"), F.col("n2")).alias("panel")).join(judged.select(item, judge_vote), item)
    return kappa(rows.where(F.col(judge_vote).isNotNull()), judge_vote, "panel", [], ties)


def chosen_margins(humans: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """(criterion, judge_diff, judge_n, human_diff, human_n): by how much the answer that the human chose beats the other (AGG23, JN8).

    ``humans`` has (key, vote, first, second) with maps of scores, ``judged`` the same scores
    of the judge and its vote; only clear votes count, and items with a valid reply.
    """
    clear = humans.where(F.col("vote").isin("1", "2")).select(key, "vote", F.col("first").alias("h_first"), F.col("second").alias("h_second"))
    rows = clear.join(judged.where("judge_vote is not null").select(key, F.col("first").alias("j_first"), F.col("second").alias("j_second")), key)
    of = F.explode(F.array(*map(F.lit, CRITERIA))).alias("criterion")
    rows = rows.select("vote", of, "h_first", "h_second", "j_first", "j_second")
    score = lambda side: F.element_at(side, F.col("criterion")).cast("string").try_cast("int")
    diff = lambda who: (score(f"{who}_first") - score(f"{who}_second")) * F.when(F.col("vote") == "1", 1).otherwise(-1)
    rows = rows.select("criterion", diff("j").alias("j"), diff("h").alias("h"))
    return rows.groupBy("criterion").agg(F.avg("j").alias("judge_diff"), F.count("j").alias("judge_n"), F.avg("h").alias("human_diff"), F.count("h").alias("human_n"))


def kappa_summary(kappas: DataFrame, judge: float) -> DataFrame:
    """Mean, deviation and quantiles of the raters' kappas, and where a judge's stands among them (AGG22)."""
    k = F.col("kappa")
    spread = F.coalesce(F.stddev_samp(k), F.lit(0.0))  # of one rater: none
    z = F.when(spread > 0, (F.lit(judge) - F.avg(k)) / spread)
    return kappas.agg(
        F.avg(k).alias("mean"),
        spread.alias("std"),
        F.percentile(k, [0.025, 0.25, 0.5, 0.75, 0.975]).alias("quantiles"),
        z.alias("z"),
        F.try_divide(F.count_if(k < judge), F.count(k)).alias("share_below"),
        (F.abs(z) <= 2).alias("within_2_std"),
    )


def chosen(vote: str, first: str, second: str) -> Column:
    """(chosen, rejected) by the human vote: 1 picks the first (PRJ17)."""
    one = F.col(vote) == "1"
    return F.struct(F.when(one, F.col(first)).otherwise(F.col(second)).alias("chosen"), F.when(one, F.col(second)).otherwise(F.col(first)).alias("rejected"))
