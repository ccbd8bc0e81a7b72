"""URL filters: host and path rules, and for the rest a path-template tree for each host."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import forget, stored, table

#: The rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A path segment stays as it is with so many urls at its place in the tree, or where its labels
#: differ from its siblings' (by SAME); else it is a wildcard.
LEAST_COUNT = 5
#: Branches are merged up to this chi-square statistic (2 degrees of freedom, 5 per cent).
SAME = 5.99
#: Pseudo-counts of blocked and other urls, and the share of blocked ones from which a template is rejected.
SMOOTH, REJECT = 1.0, 0.9
LABELS = ("block", "allow")
#: A template's last segment that isn't a wildcard, with what is before and behind it: branches alike but for it are siblings.
SIBLINGS = r"^(.*)/[^/*][^/]*((?:/\*|/)*)$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest"))
    rows = rows.withColumn("host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    return rows.select("page_id", F.translate("host", UPPER, LOWER).alias("host"), F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"^[^?#]*", 0).alias("path"))


def ruled(rows: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``rows`` with the longest rule that fits host (or a domain above it) and path, as host and path in one, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda x: len(x[1] + x[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("_given"))


def labelled() -> list[Column]:
    """The numbers of urls that the rules block and allow, as aggregates."""
    return [F.coalesce(F.sum((F.col("_given") == x).cast("long")), F.lit(0)).alias(f"_{x}") for x in LABELS]


def differs() -> Column:
    """Whether a segment's labels differ from those of its place's other urls (chi-square of blocked, allowed and unlabelled, as in ``apart``)."""
    n, every = F.col("_n").cast("double"), F.col("_all_n").cast("double")
    classes = [(F.col(f"_{x}"), F.col(f"_all_{x}")) for x in LABELS]
    classes.append((F.col("_n") - F.col("_block") - F.col("_allow"), F.col("_all_n") - F.col("_all_block") - F.col("_all_allow")))
    terms = [F.when(t > 0, F.pow(x * every - t * n, F.lit(2.0)) / (t * n * (every - n))).otherwise(0.0) for x, t in classes]
    return (F.col("_block") + F.col("_allow") > 0) & F.when(F.col("_n") < F.col("_all_n"), terms[0] + terms[1] + terms[2] > SAME).otherwise(False)


def templated(rows: DataFrame) -> DataFrame:
    """``rows`` with the template of each path, built from the root of its host's tree downwards.

    At each depth the urls of a place (host and template so far) are counted by their next
    segment, with partial sums; only segments that stay are kept and joined back. This goes on
    as long as there is a place with LEAST_COUNT urls; in smaller ones no segment can stay (the
    statistic of so few urls is below SAME), so the rest of their paths is wildcards.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_segments", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("template", F.lit(""))
    rows, depth, done = stored(rows.withColumn("_live", F.lit(True)), "urls"), 0, []
    while True:
        live = rows.where("_live").drop("_live").withColumn("_next", F.get("_segments", F.lit(depth)))
        more = F.sum((F.size("_segments") > depth + 1).cast("long")).alias("_more")
        counts = live.groupBy("host", "template", "_next").agg(F.count(F.lit(1)).alias("_n"), *labelled(), more)
        places = counts.groupBy("host", "template").agg(*(F.sum(f"_{x}").alias(f"_all_{x}") for x in ("n", *LABELS, "more")))
        likely = counts.where((F.col("_n") >= LEAST_COUNT) | (F.col("_block") + F.col("_allow") > 0) | (F.col("_next") == "")).join(places, ["host", "template"])
        named = likely.where((F.col("_n") >= LEAST_COUNT) | (F.col("_next") == "") | differs())
        named = stored(named.select("host", "template", "_next", "_more", F.lit(True).alias("_named")), "named")
        # places below wildcards: what the named segments leave
        wild = places.join(named.groupBy("host", "template").agg(F.sum("_more").alias("_gone")), ["host", "template"], "left")
        wild = wild.where(F.col("_all_more") - F.coalesce("_gone", F.lit(0)) >= LEAST_COUNT).select("host", "template", F.lit(True).alias("_wild"))
        live = live.join(named, ["host", "template", "_next"], "left").join(wild, ["host", "template"], "left")
        going = F.when(F.col("_named"), F.col("_more") >= LEAST_COUNT).otherwise(F.coalesce("_wild", F.lit(False))) & (F.size("_segments") > depth + 1)
        step = F.concat(F.lit("/"), F.when(F.col("_named"), F.col("_next")).otherwise("*"))
        rest = F.transform(F.slice("_segments", depth + 2, F.size("_segments")), lambda x: F.when(x == "", "/").otherwise("/*"))
        live = live.withColumn("_live", going).withColumn("template", F.concat("template", step, F.when(F.col("_live"), "").otherwise(F.array_join(rest, ""))))
        before, rows = rows, stored(live.select(*rows.columns), "urls")
        forget(named, *([] if done else [before]))
        done.append(rows)
        depth += 1
        if rows.where("_live").isEmpty():
            break
    every = spark.read.schema(rows.schema).parquet(*(x._granary_path for x in done))
    return every.where("not _live").drop("_live", "_segments")


def apart(a: tuple[int, int, int], b: tuple[int, int, int]) -> float:
    """Chi-square statistic of two branches' counts of blocked, allowed and unlabelled urls."""
    na, nb = sum(a), sum(b)
    out = 0.0
    for x, y in zip(a, b, strict=True):
        if x + y:
            for seen, n in ((x, na), (y, nb)):
                want = (x + y) * n / (na + nb)
                out += (seen - want) ** 2 / want
    return out


def merged(branches: pd.DataFrame) -> pd.DataFrame:
    """Blocked urls and all urls after similar branches of one host and shape, which are siblings, are put together, in order of their blocked share.

    A row of ``branches`` holds all branches of the same shares.
    """
    rows = sorted(branches.itertuples(index=False), key=lambda r: (r.block_share - r.allow_share, r.block_share))
    groups: list[list] = []
    for r in rows:
        counts = (int(r.blocked), int(r.allowed), int(r.urls - r.blocked - r.allowed))
        if groups and apart(groups[-1][0], counts) <= SAME:
            groups[-1][0] = tuple(x + y for x, y in zip(groups[-1][0], counts, strict=True))
            groups[-1][1].append(r)
        else:
            groups.append([counts, [r]])
    return pd.DataFrame([(r.host, r.shape, r.block_share, r.allow_share, c[0], sum(c)) for c, rs in groups for r in rs], columns=["host", "shape", "block_share", "allow_share", "blocked", "urls"])


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page.

    The rules' verdicts label the urls they fit. A url without a rule takes the verdict of its
    template: block where the smoothed share of blocked urls among all urls of the template, and
    of those merged with it, is REJECT or more; else allow, also without labels. Siblings
    that have the same shares are summed up on the executors before they are
    merged, so a merge has a row for each different pair of shares, however many branches and
    urls a host has. Null urls and those without ``://`` have an empty host and path, and so one
    template; repeated rows and null ids stay; other columns are ignored; an empty table gives
    no rows.
    """
    rows = templated(ruled(with_parts(pages), rules))
    shares = rows.groupBy("host", "template").agg(*labelled(), F.count(F.lit(1)).alias("urls"))
    shares = shares.withColumn("shape", F.regexp_replace("template", SIBLINGS, "$1/?$2"))
    shares = stored(shares.withColumn("block_share", F.col("_block") / F.col("urls")).withColumn("allow_share", F.col("_allow") / F.col("urls")), "shares")
    keys = ["host", "shape", "block_share", "allow_share"]
    alike = shares.groupBy(*keys).agg(F.sum("_block").alias("blocked"), F.sum("_allow").alias("allowed"), F.sum("urls").alias("urls"))
    merge = alike.groupBy("host", "shape").applyInPandas(merged, "host string, shape string, block_share double, allow_share double, blocked long, urls long")
    purity = (F.col("blocked") + SMOOTH) / (F.col("urls") + 2 * SMOOTH)
    rejected = shares.drop("urls").join(merge.where(purity >= REJECT), keys).select("host", "template", F.lit("block").alias("_verdict"))
    rejected = stored(rejected, "verdicts")
    forget(shares)
    return rows.join(rejected, ["host", "template"], "left").select("page_id", "host", "path", "rule", F.coalesce("_given", "_verdict", F.lit("allow")).alias("verdict"), "template")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
