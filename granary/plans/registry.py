"""Queries by name over the driver's tables, with DuckDB SQL for the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text
from granary.functions.parsing import flat_content
from granary.functions.vocabulary import CONTINENT_OF, GEOGRAPHY_ALIASES
from granary.operators import conversations as talk
from granary.operators import decontam, divergence, generation, judge, metadata, profile, rubric, sampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOKENS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"
_ARRAY = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
N_TEXT = _TOKENS.format("text")


@query(
    "corpus_profile",
    f"""WITH d AS (SELECT source, doc_id, {N_TEXT} AS n FROM documents)
    SELECT source, count(*) AS total, count(*) FILTER (n = 0) AS empty, count(doc_id) - count(DISTINCT doc_id) AS dup_ids,
           round(avg(n) FILTER (n > 0), 1) AS avg_tokens, max(n) AS max_tokens FROM d GROUP BY source""",
)
def corpus_profile(spark, sf_dir):
    return profile.profile(t(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query(
    "top_sources",
    """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM c)
    SELECT lang, string_agg(source || '=' || n, ';' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY lang""",
)
def top_sources(spark, sf_dir):
    return profile.top_counts(t(spark, sf_dir, "documents"), "lang", "source")


@query("composition_rollup", f"SELECT lang, source, count(*) AS records, CAST(sum({N_TEXT}) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP (lang, source)")
def composition_rollup(spark, sf_dir):
    return profile.composition(t(spark, sf_dir, "documents"), "lang", "source", "text")


_PAIRS = """SELECT conv_id, min_by(text, turn) FILTER (lower(role) IN ('human', 'user')) AS question,
  min_by(text, turn) FILTER (lower(role) IN ('assistant', 'gpt', 'ai')) AS answer FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"""


@query("first_turn_pairs", f"SELECT *, trim(concat_ws(chr(10) || chr(10), nullif(question, ''), nullif(answer, '')), ' ' || chr(9) || chr(10) || chr(13)) AS full_text FROM ({_PAIRS})")
def first_turn_pairs(spark, sf_dir):
    return talk.first_pairs(t(spark, sf_dir, "conversations"), "conv_id")


@query(
    "task_format_stats",
    f"""WITH p AS (SELECT question IS NOT NULL AND answer IS NOT NULL AS paired,
      coalesce(contains(question, 'A)')::int + contains(question, 'B)')::int + contains(question, 'C)')::int + contains(question, 'D)')::int + contains(question, 'E)')::int >= 2, false) AS mcq,
      coalesce(contains(answer, '<think>') AND contains(answer, '</think>'), false) AS think,
      {_TOKENS.format("coalesce(question, '')")} AS q, {_TOKENS.format("coalesce(answer, '')")} AS a, conv_id % 3 = 0 AS document FROM ({_PAIRS}))
    SELECT count(*) AS n, avg(paired::int) * 100 AS pct_paired, avg(mcq::int) * 100 AS pct_mcq, avg(document::int) * 100 AS pct_document, avg(think::int) * 100 AS pct_think, median(q) AS median_q, median(a) AS median_a, median(q + a) AS median_full FROM p""",
)
def task_format_stats(spark, sf_dir):
    return profile.task_format(first_turn_pairs(spark, sf_dir).withColumn("is_document", F.col("conv_id") % 3 == 0))


@query("system_turn_strip", "SELECT conv_id, turn, role, text FROM conversations WHERE role IS NULL OR role <> 'system'")
def system_turn_strip(spark, sf_dir):
    # the exploded form of operators.conversations.without_system
    return t(spark, sf_dir, "conversations").where("role is null or role <> 'system'").select("conv_id", "turn", "role", "text")


@query("prompt_body_truncate", "SELECT doc_id, CASE WHEN length(text) > 6200 THEN left(text, 4000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 2000) ELSE text END AS body FROM documents")
def prompt_body_truncate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", talk.document_body("text").alias("body"))


@query("first_wins_dedup", "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY md5(text)")
def first_wins_dedup(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return profile.first_of(rows, "key", "doc_id")


_KEY = "left(sha256({0} || chr(0) || CAST(doc_id AS VARCHAR)), 16)"


@query("hash_reservoir", f"SELECT doc_id, lang FROM documents ORDER BY {_KEY.format(chr(39) + '42' + chr(39))}, doc_id LIMIT 100")
def hash_reservoir(spark, sf_dir):
    return sampling.bottom(t(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id", 42)


@query(
    "stratified_sample",
    f"""WITH s AS (SELECT lang AS stratum, count(*) AS size FROM documents GROUP BY lang),
    a AS (SELECT *, least(1, size) AS first, 50 - sum(least(1, size)) OVER () AS remaining, size - least(1, size) AS room FROM s),
    b AS (SELECT *, remaining * room / sum(room) OVER () AS share FROM a),
    c AS (SELECT *, floor(share) AS whole, remaining - sum(floor(share)) OVER () AS spare, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS place FROM b),
    k AS (SELECT stratum, first + whole + (place <= spare AND whole < room)::int AS take FROM c),
    r AS (SELECT doc_id, lang, take, row_number() OVER (PARTITION BY lang ORDER BY {_KEY.format("('7::' || lang)")}, doc_id) AS r FROM documents JOIN k ON lang = stratum)
    SELECT doc_id, lang FROM r WHERE r <= take""",
)
def stratified_sample(spark, sf_dir):
    return sampling.stratified(t(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "lang", "doc_id", 7)


_NGRAMS = "SELECT DISTINCT {0}, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 8 + 1)) AS i FROM (SELECT {0}, " + _ARRAY.format("text") + " AS w FROM {1}))"
_CANDIDATES = f"SELECT DISTINCT doc_id, item_id FROM ({_NGRAMS.format('doc_id', 'documents')}) JOIN ({_NGRAMS.format('item_id', 'benchmark')}) USING (g)"


@query("ngram_semi_prefilter", f"SELECT DISTINCT doc_id FROM ({_CANDIDATES})")
def ngram_semi_prefilter(spark, sf_dir):
    return decontam.prefiltered(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), "doc_id")


@query("decontam_candidates", _CANDIDATES)
def decontam_candidates(spark, sf_dir):
    return decontam.candidates(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("decontam_verify")
def decontam_verify(spark, sf_dir):
    docs, items = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    return decontam.verified(decontam.candidates(docs, items, "doc_id", "item_id"), docs, items, "doc_id", "item_id")


@query("decontaminate")
def decontaminate(spark, sf_dir):
    found = decontam.report(decontam_verify(spark, sf_dir), "doc_id", "item_id")
    return decontam.decontaminated(t(spark, sf_dir, "documents"), found, "doc_id")


@query("decontam_filter", f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_CANDIDATES}))")
def decontam_filter(spark, sf_dir):
    return decontam.decontaminated(t(spark, sf_dir, "documents").select("doc_id", "source"), decontam_candidates(spark, sf_dir), "doc_id")


@query("contamination_counts", f"SELECT source, count(DISTINCT doc_id) AS n FROM ({_CANDIDATES}) JOIN documents USING (doc_id) GROUP BY source ORDER BY n DESC, source LIMIT 20")
def contamination_counts(spark, sf_dir):
    found = decontam_candidates(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return decontam.contamination_counts(found, "doc_id", "source")


@query("resume_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_PROMPTS = "SELECT conv_id, turn, 't0.7_n2048_' || sha256(text) AS key FROM conversations WHERE role = 'user'"
_CACHE = "SELECT 't0.7_n2048_' || sha256(text) AS key, max_by(conv_id || ':' || turn, conv_id * 1000 + turn) AS answer FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1"


@query("answer_cache_join", f"SELECT conv_id, turn, key, answer FROM ({_PROMPTS}) LEFT JOIN ({_CACHE}) USING (key)")
def answer_cache_join(spark, sf_dir):
    prompts = t(spark, sf_dir, "conversations").where("role = 'user'").withColumn("key", generation.prompt_key("text", 0.7, 2048))
    given = prompts.where("conv_id % 2 = 0").select("key", F.concat_ws(":", "conv_id", "turn").alias("answer"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return generation.answered(prompts.select("conv_id", "turn", "key"), generation.latest(given, "at")).select("conv_id", "turn", "key", "answer")


_SHARES = """SELECT arm, category, coalesce(n, 0) AS n, coalesce(coalesce(n, 0) / nullif(sum(n) OVER (PARTITION BY arm), 0), 0) AS p
  FROM (SELECT DISTINCT quality AS arm FROM labels) CROSS JOIN (SELECT DISTINCT lang AS category FROM documents)
  LEFT JOIN (SELECT quality AS arm, lang AS category, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) USING (arm, category)"""


def _arms(spark, sf_dir):
    docs, labels = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id"), docs.select(F.col("lang").alias("category"))


@query("category_proportions", f"SELECT arm, category, n, round(p, 9) AS p FROM ({_SHARES})")
def category_proportions(spark, sf_dir):
    rows, vocabulary = _arms(spark, sf_dir)
    return divergence.proportions(rows, "quality", "lang", vocabulary).withColumn("p", F.round("p", 9))


@query(
    "jsd_tv_by_field",
    f"""WITH a AS (SELECT category, sum(p) FILTER (arm = 1) AS p, sum(p) FILTER (arm = 0) AS q FROM ({_SHARES}) GROUP BY category),
    v AS (SELECT greatest(0, least(1, (coalesce(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) END), 0) + coalesce(sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) END), 0)) / 2)) AS jsd, sum(abs(p - q)) / 2 AS tv FROM a)
    SELECT round(jsd, 9) AS jsd, round(tv, 9) AS tv, CASE WHEN jsd < 0.05 THEN 'near-identical' WHEN jsd < 0.15 THEN 'small shift' WHEN jsd < 0.3 THEN 'moderate shift' WHEN jsd < 0.5 THEN 'large shift' ELSE 'severe shift' END AS label FROM v""",
)
def jsd_tv_by_field(spark, sf_dir):
    rows, vocabulary = _arms(spark, sf_dir)
    pairs = divergence.aligned(divergence.proportions(rows, "quality", "lang", vocabulary), 1, 0)
    out = pairs.agg(divergence.jensen_shannon().alias("jsd"), divergence.total_variation().alias("tv"))
    return out.select(F.round("jsd", 9).alias("jsd"), F.round("tv", 9).alias("tv"), text.jsd_label("jsd").alias("label"))


@query(
    "wasserstein_ordinal",
    """WITH c AS (SELECT least(n_chars // 500, 20) AS v, count(*) FILTER (quality = 1) AS na, count(*) FILTER (quality = 0) AS nb FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    g AS (SELECT sum(na) OVER (ORDER BY v) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY v) / sum(nb) OVER () AS fb, coalesce(lead(v) OVER (ORDER BY v) - v, 0) AS width FROM c)
    SELECT round(sum(abs(fa - fb) * width), 9) AS w1 FROM g""",
)
def wasserstein_ordinal(spark, sf_dir):
    rows, _ = _arms(spark, sf_dir)
    rows = rows.withColumn("v", F.least(F.floor(F.col("n_chars") / 500), F.lit(20)))
    return divergence.wasserstein(rows, "quality", "v", 1, 0).select(F.round("w1", 9).alias("w1"))


@query("arm_centres", "SELECT quality AS arm, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def arm_centres(spark, sf_dir):
    return divergence.centres(_arms(spark, sf_dir)[0], "quality", "n_chars").withColumn("mean", F.round("mean", 6))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    rows, _ = _arms(spark, sf_dir)
    counts = rows.groupBy(F.lit("lang").alias("field"), F.col("lang").alias("category")).agg(F.count_if(F.col("quality") == 1).alias("n_a"), F.count_if(F.col("quality") == 0).alias("n_b"))
    return divergence.bootstrap_counts(counts, ["field"])


# replies that need each step of the extraction: {x} and {y} are letters, {d} is a digit
_REPLIES = (
    "So the answer is ({x}). No: answer is {y}",
    "THE ANSWER IS {x}) as said",
    "**Answer:** {x}\nthe end",
    "Answer\n\n{x}",
    "Answer: $\\boxed{{{x}}}$",
    "The answer is $\\boxed{{{x}}}$",
    "answer: none of these",
    "**{x}.** because of it, not **{y} -**",
    "Only ** {x} - ** fits",
    "I take option  {d}, not Option 1",
    "no letter",
    "",
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _filled(template: str, sql: bool) -> str:
    """The template as an expression in SQL of either engine."""
    given = {"x": "chr(65 + CAST(event_id % 11 AS INT))", "y": "chr(65 + CAST(user_id % 5 AS INT))", "d": "CAST(1 + event_id % 5 AS VARCHAR)" if sql else "CAST(1 + event_id % 5 AS STRING)"}
    mark = {k: f"\0{k}\0" for k in given}
    parts = template.format(**mark).split("\0")
    quoted = [given[x] if i % 2 else _quoted(x) if sql else "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" for i, x in enumerate(parts)]
    return " || ".join(quoted)


def _cases(templates: tuple[str, ...], sql: bool) -> str:
    cases = " ".join(f"WHEN {i} THEN {_filled(x, sql)}" for i, x in enumerate(templates))
    return f"CASE CAST(event_id % {len(templates)} AS INT) {cases} END"


_LABEL = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE chr(97 + CAST(user_id % 5 AS INT)) END"


@query(
    "answer_letter_extract",
    rf"""WITH r AS (SELECT event_id, {_LABEL} AS label, {_cases(_REPLIES, True)} AS t FROM events),
    x AS (SELECT *, regexp_extract_all(t, '(?i)answer is \(?([A-J])\)?', 1) AS a, regexp_extract_all(t, '(?i)Answer[^A-J]*(?::)*[^A-J]*(?:boxed)*[^A-J]*([A-J])\b', 1) AS b FROM r),
    f AS (SELECT *, CASE WHEN len(a) > 0 THEN upper(a[-1]) WHEN len(b) > 0 THEN upper(b[-1]) ELSE 'INVALID' END AS letter, CASE WHEN len(a) > 0 THEN 'mmlu_pro' WHEN len(b) > 0 THEN 'medmcqa' END AS pattern FROM x)
    SELECT event_id, letter, CASE WHEN label IS NULL THEN NULL ELSE pattern END AS pattern, CASE WHEN label IS NOT NULL THEN letter = upper(label) END AS exact_match FROM f""",
)
def answer_letter_extract(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.expr(_LABEL).alias("label"), F.expr(_cases(_REPLIES, False)).alias("t"))
    found = text.exact_match("t", "label")
    return rows.select("event_id", text.exact_letter("t").alias("letter"), found["pattern"].alias("pattern"), found["exact_match"].alias("exact_match"))


@query(
    "chosen_letter_extract",
    rf"""WITH r AS (SELECT event_id, {_cases(_REPLIES, True)} AS t FROM events),
    x AS (SELECT event_id, regexp_extract_all(t, 'answer is \(?([A-J])\)?', 1) AS a, regexp_extract_all(t, '(?i)Answer[^A-E]*(?::)*[^A-E]*(?:boxed)*[^A-E]*([A-E])\b', 1) AS b,
      regexp_extract_all(t, '\*\*\s*([A-E])\s*[.\-–]', 1) AS c, regexp_extract_all(t, '(?i)Option\s*([1-5])', 1) AS d FROM r)
    SELECT event_id, CASE WHEN len(a) > 0 THEN upper(a[-1]) WHEN len(b) > 0 THEN upper(b[-1]) WHEN len(c) > 0 THEN c[1] WHEN len(d) > 0 THEN chr(64 + CAST(d[1] AS INT)) ELSE 'Unknown' END AS letter FROM x""",
)
def chosen_letter_extract(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", text.chosen_letter(F.expr(_cases(_REPLIES, False))).alias("letter"))


_TAGGED = (
    "<question>Why {x}?</question>\n<answer>It is {y}.</answer>",
    "<question>Why {x}?\n<answer>It is {y}.",
    "<Question> {x} --- Answer --- {y}\nmore </ANSWER>",
    "<question> </question><answer>{x}</answer>",
    "<question>{x}</question> and no more",
    "<answer>{x}</answer> <question>{y}</question>",
    "{x}",
)


@query(
    "qa_tag_extract",
    rf"""WITH r AS (SELECT event_id, {_cases(_TAGGED, True)} AS t FROM events),
    x AS (SELECT event_id, trim(regexp_extract(t, '(?is)<question>(.*?)(?:</question>|<answer>|---\s*Answer\s*---)', 1), ' ' || chr(10)) AS q, trim(regexp_extract(t, '(?is)(?:<answer>|---\s*Answer\s*---)(.*)', 1), ' ' || chr(10)) AS a FROM r),
    y AS (SELECT event_id, q, trim(regexp_replace(a, '(?i)</answer>$', ''), ' ' || chr(10)) AS a FROM x)
    SELECT event_id, q AS question, a AS answer FROM y WHERE q <> '' AND a <> ''""",
)
def qa_tag_extract(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", text.question_answer(F.expr(_cases(_TAGGED, False))).alias("p"))
    return rows.where("p is not null").select("event_id", "p.*")


_BLOCKS = (
    "<qa>\n<question>{x}1</question>\n<answer>{y}1</answer>\n</qa> and <QA><question>{x}2</question><answer>{y}\n2</answer></QA>",
    "<question>{x}</question><answer>{y}</answer>",
    "<qa><question>{x}</question> <answer> </answer></qa><qa> <question>{y}</question><answer>{x}</answer> </qa>",
    "<qa><question>{x}<answer>{y}</answer></qa>",
)


@query(
    "qa_block_explode",
    rf"""WITH r AS (SELECT event_id, {_cases(_BLOCKS, True)} AS t FROM events),
    x AS (SELECT event_id, unnest(regexp_extract_all(t, '(?is)<qa>\s*<question>(.*?)</question>\s*<answer>(.*?)</answer>\s*</qa>', 1)) AS q, unnest(regexp_extract_all(t, '(?is)<qa>\s*<question>(.*?)</question>\s*<answer>(.*?)</answer>\s*</qa>', 2)) AS a FROM r)
    SELECT event_id, trim(q, ' ' || chr(10)) AS question, trim(a, ' ' || chr(10)) AS answer FROM x WHERE trim(q, ' ' || chr(10)) <> '' AND trim(a, ' ' || chr(10)) <> ''""",
)
def qa_block_explode(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.inline(text.qa_blocks(F.expr(_cases(_BLOCKS, False)))))


_LOGS = (
    "export MODEL_PATH=/models/{x} v2\nTraceback (most recent call last)\nValueError: {y}\nKeyError: late\nok\nExit code: 1",
    "run --args pretrained=org/{x},dtype=auto\nTraining completed\nExit code: 3\nExit code: 0",
    "CUDNN_STATUS_ALLOC_FAILED\nError: first {x}\nERROR: second\nexit code: 9",
    "step 1 loss is NaN for {x}\nFAILED here",
    "OSError: [Errno 24] {x}\nnothing finished\nExit code: x",
    "banana nanny finished {x}\nFINISHED",
    "Traceback\nno more\nError: before {x}",
    "{{'loss': 2.5, 'epoch': 0.1}} 10%|#  | 1/10 [00:01<00:09]\n{{'loss': 1.2{d}, 'epoch': 0.2}} 20%|## | 2/10 [00:02<00:08]",
    "Elapsed: 01:02:03\n{{'loss': 3.0}}\nelapsed so far 0{d}:05:06 and 23:59:5{d}",
)
_LINES = "string_split(t, chr(10))"


@query(
    "log_summary",
    rf"""WITH r AS (SELECT event_id, {_cases(_LOGS, True)} AS t FROM events),
    l AS (SELECT *, {_LINES} AS ls, list_filter({_LINES}, lambda x: contains(x, 'Exit code:'))[-1] AS e, list_position(list_transform({_LINES}, lambda x: contains(x, 'Traceback')), true) AS tb FROM r),
    c AS (SELECT *, nullif(regexp_extract(string_split(e, 'Exit code: ')[2], '^([0-9]*)', 1), '') AS code FROM l)
    SELECT event_id, CASE WHEN code = '0' THEN 'COMPLETED' WHEN code IS NOT NULL THEN 'FAILED (exit code ' || code || ')' ELSE 'UNKNOWN' END AS status,
      CASE WHEN regexp_matches(t, '(?i)cuda out of memory|cudnn_status_alloc_failed|cublas_status_alloc_failed|out of memory') THEN 'OOM' WHEN regexp_matches(t, '(?i)\bnan\b|loss is nan|nan loss') THEN 'NAN'
           WHEN regexp_matches(t, '(?i)too many open files|errno 24') THEN 'FD_LIMIT' WHEN regexp_matches(t, '(?i)training finished|training completed') THEN 'FINISHED' ELSE 'IDK' END AS cause,
      coalesce(CASE WHEN tb IS NOT NULL THEN list_filter(ls[tb:], lambda x: regexp_matches(x, '(Error|Exception)'))[-1] END, list_filter(ls, lambda x: regexp_matches(x, 'ERROR:|Error:|FAILED|exit code: [1-9]'))[1], 'UNKNOWN') AS error,
      coalesce(regexp_extract(list_filter(ls, lambda x: contains(x, 'MODEL_PATH='))[1], 'MODEL_PATH=(.*)', 1), regexp_extract(list_filter(ls, lambda x: contains(x, 'pretrained='))[1], '.*pretrained=([^, ]+)', 1), 'UNKNOWN') AS model FROM c""",
)
def log_summary(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.expr(_cases(_LOGS, False)).alias("t"))
    return rows.select("event_id", text.log_status("t").alias("status"), text.log_cause("t").alias("cause"), text.last_error("t").alias("error"), text.model_path("t").alias("model"))


@query(
    "training_state",
    rf"""WITH r AS (SELECT event_id, {_cases(_LOGS, True)} AS t FROM events),
    e AS (SELECT *, regexp_extract_all(array_to_string(list_filter({_LINES}, lambda x: contains(lower(x), 'elapsed')), chr(10)), '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')[-1] AS elapsed FROM r),
    s AS (SELECT *, elapsed IS NULL AND (regexp_matches(t, '(?i)out of memory|_status_alloc_failed|\bnan\b|errno 24') OR NOT regexp_matches(t, '(?i)training finished|training completed')) AS running FROM e)
    SELECT event_id, elapsed, CASE WHEN running THEN regexp_extract_all(t, '[0-9]{{1,3}}%\|[^|]*\|[[:space:]]*[0-9]+/[0-9]+[[:space:]]*\[[^\]]+\]')[-1] END AS progress,
      CASE WHEN running THEN regexp_extract_all(t, chr(39) || 'loss' || chr(39) || ':[[:space:]]*[0-9.]+')[-1] END AS loss, CASE WHEN running THEN regexp_extract_all(t, chr(39) || 'epoch' || chr(39) || ':[[:space:]]*[0-9.]+')[-1] END AS epoch FROM s""",
)
def training_state(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.expr(_cases(_LOGS, False)).alias("t"))
    return rows.select("event_id", text.training_state("t").alias("s")).select("event_id", "s.elapsed", "s.progress", "s.loss", "s.epoch")


_ATTEMPTS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type AS text, CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type = 'purchase' END AS match FROM events"


def _attempts(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t(spark, sf_dir, "events").withColumn("attempt", F.row_number().over(w))
    return rows.select("user_id", "attempt", F.col("event_type").alias("text"), F.when(F.col("user_id") % 5 != 0, F.col("event_type") == "purchase").alias("match"))


@query(
    "rejection_closed_form",
    f"""WITH a AS (SELECT * FROM ({_ATTEMPTS}) WHERE attempt <= 8),
    s AS (SELECT user_id, CASE WHEN count(match) = 0 THEN min(attempt) ELSE coalesce(min(attempt) FILTER (match), max(attempt)) END AS try_count FROM a GROUP BY user_id)
    SELECT user_id, CAST(try_count AS INT) AS try_count, text, match AS exact_match FROM a JOIN s USING (user_id) WHERE attempt = try_count""",
)
def rejection_closed_form(spark, sf_dir):
    return generation.accepted(_attempts(spark, sf_dir), "user_id")


@query("attempt_accuracy", f"SELECT CAST(attempt AS INT) AS attempt, count(match) AS labelled, count(*) FILTER (match) AS matched, count(*) FILTER (match) / nullif(count(match), 0) AS accuracy FROM ({_ATTEMPTS}) WHERE attempt <= 8 GROUP BY attempt")
def attempt_accuracy(spark, sf_dir):
    return generation.attempt_accuracy(_attempts(spark, sf_dir).where("attempt <= 8"))


_PLACES = list(CONTINENT_OF.items())
_V = "lower(trim(coalesce(n_name, '')))"


@query(
    "geo_bin",
    f"""SELECT n_nationkey, CASE WHEN {_V} IN ('', {", ".join(map(_quoted, GEOGRAPHY_ALIASES))}) THEN 'unspecified'
    {" ".join(f"WHEN {_V} = {_quoted(n)} THEN {_quoted(p)}" for n, p in _PLACES)}
    {" ".join(f"WHEN contains({_V}, {_quoted(n)}) THEN {_quoted(p)}" for n, p in _PLACES)} ELSE 'other' END AS place FROM nation""",
)
def geo_bin(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", text.continent("n_name").alias("place"))


_VOTES = "SELECT event_id // 5 AS item, event_id % 5 AS rater, ['1', '2', '12'][1 + (event_id * 7 + user_id) % 3] AS vote FROM events"


def _votes(spark, sf_dir):
    vote = F.element_at(F.array(*map(F.lit, ("1", "2", "12"))), (1 + (F.col("event_id") * 7 + F.col("user_id")) % 3).cast("int"))
    return t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("item"), (F.col("event_id") % 5).alias("rater"), vote.alias("vote"))


@query(
    "win_rates",
    f"""WITH v AS (SELECT rater, CASE WHEN item % 11 = 0 THEN 'Unknown' WHEN vote = '1' THEN 'Model 1' WHEN vote = '2' THEN 'Model 2' ELSE 'Tie' END AS w FROM ({_VOTES})),
    c AS (SELECT rater, count(*) AS n_total, count(*) FILTER (w <> 'Unknown') AS n_decided, count(*) FILTER (w = 'Model 1') AS n_1, count(*) FILTER (w = 'Model 2') AS n_2, count(*) FILTER (w = 'Tie') AS n_tie FROM v GROUP BY rater)
    SELECT *, n_2 / n_decided AS win_2, (n_2 - n_1) / n_decided AS net, (n_2 + 0.5 * n_tie)::double / n_decided AS adjusted FROM c""",
)
def win_rates(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for x in ("1", "Model 1", "2", "Model 2", "12", "Tie")))
    rows = _votes(spark, sf_dir).withColumn("winner", F.when(F.col("item") % 11 == 0, "Unknown").otherwise(F.element_at(names, F.col("vote"))))
    return judge.win_rates(rows, "winner", "rater")


_VERDICT = "CASE WHEN greatest({0}, {1}, {2}) = 0 THEN NULL WHEN ({0} = greatest({0}, {1}, {2}))::int + ({1} = greatest({0}, {1}, {2}))::int + ({2} = greatest({0}, {1}, {2}))::int > 1 THEN '12' WHEN {0} = greatest({0}, {1}, {2}) THEN '1' WHEN {1} = greatest({0}, {1}, {2}) THEN '2' ELSE '12' END"
_COUNTS = f"SELECT item, count(*) FILTER (vote = '1') AS a, count(*) FILTER (vote = '2') AS b, count(*) FILTER (vote = '12') AS c FROM ({_VOTES}) GROUP BY item"


@query("panel_verdict", f"SELECT item, {_VERDICT.format('a', 'b', 'c')} AS verdict FROM ({_COUNTS})")
def panel_verdict(spark, sf_dir):
    return judge.panel(_votes(spark, sf_dir), "item", "vote")


@query(
    "kappa_leave_one_out",
    f"""WITH o AS (SELECT rater, vote, {_VERDICT.format("(a - (vote = '1')::int)", "(b - (vote = '2')::int)", "(c - (vote = '12')::int)")} AS others FROM ({_VOTES}) JOIN ({_COUNTS}) USING (item)),
    k AS (SELECT rater, count(*) AS n, avg((vote = others)::int) AS agreement,
      avg((vote = '1')::int) * avg((others = '1')::int) + avg((vote = '2')::int) * avg((others = '2')::int) + avg((vote = '12')::int) * avg((others = '12')::int) AS chance FROM o WHERE others IS NOT NULL GROUP BY rater)
    SELECT rater, n, round(agreement, 9) AS agreement, round(CASE WHEN chance >= 1 THEN 1 ELSE (agreement - chance) / (1 - chance) END, 9) AS kappa FROM k""",
)
def kappa_leave_one_out(spark, sf_dir):
    return judge.rater_kappas(_votes(spark, sf_dir), "item", "rater", "vote").select("rater", "n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


_GRADED = "SELECT l_orderkey, l_returnflag AS tag, CASE WHEN l_linenumber % 4 = 0 THEN -l_quantity ELSE l_quantity END AS points, l_linestatus = 'F' AS met FROM lineitem"
_SCORE = "sum(CASE WHEN met THEN points ELSE 0 END) / nullif(sum(CASE WHEN points > 0 THEN points ELSE 0 END), 0)"


def _graded(spark, sf_dir):
    points = F.when(F.col("l_linenumber") % 4 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_returnflag").alias("tags"), points.alias("points"), (F.col("l_linestatus") == "F").alias("met"))


@query("rubric_score", f"SELECT l_orderkey, round({_SCORE}, 9) AS score FROM ({_GRADED}) GROUP BY l_orderkey")
def rubric_score(spark, sf_dir):
    return rubric.scores(_graded(spark, sf_dir), "l_orderkey").withColumn("score", F.round("score", 9))


@query(
    "tag_scores",
    f"""WITH g AS ({_GRADED}), o AS (SELECT l_orderkey, {_SCORE} AS score FROM g GROUP BY l_orderkey),
    e AS (SELECT l_orderkey, 'overall' AS tag, score, 0 AS r FROM o
      UNION ALL SELECT l_orderkey, o_orderpriority, score, 1 FROM o JOIN orders ON l_orderkey = o_orderkey
      UNION ALL SELECT l_orderkey, tag, {_SCORE}, 0 FROM g GROUP BY l_orderkey, tag),
    s AS (SELECT l_orderkey, tag, min_by(score, r) AS score FROM e GROUP BY ALL)
    SELECT tag, count(*) AS n, round(greatest(0, least(1, avg(score))), 9) AS mean FROM s WHERE score IS NOT NULL GROUP BY tag""",
)
def tag_scores(spark, sf_dir):
    tags = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_orderpriority").alias("example_tags"))
    scored = rubric.tag_scores(_graded(spark, sf_dir), "l_orderkey", tags)
    return rubric.clipped_means(scored, "tag").select("tag", "n", F.round("mean", 9).alias("mean"))


@query("label_distribution", "SELECT quality, count(*) AS n, count(*) * 100.0::double / sum(count(*)) OVER () AS pct FROM labels GROUP BY quality")
def label_distribution(spark, sf_dir):
    return profile.distribution(t(spark, sf_dir, "labels"), "quality")


@query("length_histogram", "WITH b AS (SELECT least(floor(n_chars / 1000.0), 4)::bigint AS bin FROM documents WHERE n_chars BETWEEN 0 AND 5000) SELECT bin, count(*) AS n, count(*) / sum(count(*)) OVER () AS density FROM b GROUP BY bin")
def length_histogram(spark, sf_dir):
    return profile.histogram(t(spark, sf_dir, "documents"), "n_chars", 0, 5000)


@query("frequent_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 50")
def frequent_sources(spark, sf_dir):
    return profile.frequent(t(spark, sf_dir, "documents"), "source", 50)


@query("swap_coin", "SELECT conv_id, right(left(sha256('0' || chr(0) || CAST(conv_id AS VARCHAR)), 16), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swap FROM (SELECT DISTINCT conv_id FROM conversations)")
def swap_coin(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("swap", sampling.swap_coin("conv_id"))


@query(
    "html_text_flatten",
    """SELECT page_id, concat_ws(chr(10) || chr(10), CASE WHEN trim(url) <> '' THEN '## address' || chr(10) || chr(10) || url END, CASE WHEN trim(html) <> '' THEN '## page' || chr(10) || chr(10) || html END,
      CASE WHEN trim(html) <> '' THEN '## again' || chr(10) || chr(10) || html ELSE '' END) AS body FROM pages""",
)
def html_text_flatten(spark, sf_dir):
    # sections, a nested one that loses its heading, and values that are no text
    nested = F.struct(F.col("html").alias("again"), F.lit(" ").alias("blank"), F.lit(1).alias("number"))
    record = F.to_json(F.struct(F.col("url").alias("address"), F.col("html").alias("page"), nested.alias("more"), F.array("url").alias("list"), F.length("html").alias("size")))
    return t(spark, sf_dir, "pages").select("page_id", flat_content(record).alias("body"))


_SCORES = """SELECT event_id AS item, 'Clarity' AS criterion, event_id % 5 + 1 AS a, (event_id * 3) % 5 + 1 AS b FROM events
  UNION ALL SELECT event_id, 'Fairness', user_id % 5 + 1, (event_id + user_id) % 5 + 1 FROM events WHERE event_id % 4 <> 0"""


def _scores(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    of = lambda clarity, fairness: F.create_map(F.lit("Clarity"), clarity, F.lit("Fairness"), fairness)
    second = of(e * 3 % 5 + 1, F.when(e % 4 != 0, (e + u) % 5 + 1))
    return t(spark, sf_dir, "events").select(e.alias("item"), of(e % 5 + 1, u % 5 + 1).alias("first"), second.alias("second"))


@query("likert_means", f"SELECT criterion, avg(a) AS mean_1, avg(b) AS mean_2, avg(b - a) AS diff, count(*) AS n FROM ({_SCORES}) GROUP BY criterion")
def likert_means(spark, sf_dir):
    return judge.likert(_scores(spark, sf_dir), "item", "first", "second")


@query("likert_delta", f"SELECT round(avg(d), 9) AS delta FROM (SELECT item, avg(b - a) AS d FROM ({_SCORES}) GROUP BY item)")
def likert_delta(spark, sf_dir):
    return judge.overall_delta(_scores(spark, sf_dir), "item", "first", "second").select(F.round("delta", 9).alias("delta"))


@query(
    "kappa_summary",
    f"""WITH k AS ({SQL["kappa_leave_one_out"]})
    SELECT round(avg(kappa), 8) AS mean, round(quantile_cont(kappa, 0.5), 8) AS median, count(*) FILTER (kappa < 0.01) / count(*) AS share_below FROM k""",
)
def kappa_summary(spark, sf_dir):
    out = judge.kappa_summary(kappa_leave_one_out(spark, sf_dir), 0.01)
    return out.select(F.round("mean", 8).alias("mean"), F.round(F.col("quantiles")[2], 8).alias("median"), "share_below")


@query("problem_samples", f"SELECT doc_id, source, CAST(rank AS INT) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_KEY.format(chr(39) + '0' + chr(39))}, doc_id) AS rank FROM documents) WHERE rank <= 5")
def problem_samples(spark, sf_dir):
    return sampling.problem_samples(t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query("few_shot_draws")
def few_shot_draws(spark, sf_dir):
    pool = sampling.numbered(t(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "example")
    return sampling.few_shot(t(spark, sf_dir, "labels").select("doc_id"), pool, "doc_id").select("doc_id", "shot", "item_id")


@query(
    "pair_groups",
    "WITH k AS (SELECT doc_id, md5(concat(coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS key FROM documents) SELECT key, min(doc_id) AS doc_id, count(*) AS n_rows FROM k GROUP BY key",
)
def pair_groups(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").withColumn("parent", F.lit(None).cast("string"))
    return profile.grouped_by_pair(rows.select("doc_id", profile.pair_key("parent", "lang", "source", "text").alias("key")), "key", "doc_id")


@query(
    "shown_categories",
    """WITH s AS (SELECT source AS category, count(*) FILTER (quality = 1) / sum(count(*) FILTER (quality = 1)) OVER () AS prop_source, count(*) FILTER (quality = 0) / sum(count(*) FILTER (quality = 0)) OVER () AS prop_synthetic FROM documents JOIN labels USING (doc_id) GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY greatest(prop_source, prop_synthetic) DESC, category) AS r, count(*) OVER () AS n FROM s)
    SELECT category, prop_source, prop_synthetic FROM r WHERE n <= 12 OR greatest(prop_source, prop_synthetic) >= 0.005 OR r <= 12""",
)
def shown_categories(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category")).join(t(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("category").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b"))
    shares = counts.select("category", (F.col("a") / counts.agg(F.sum("a")).scalar()).alias("prop_source"), (F.col("b") / counts.agg(F.sum("b")).scalar()).alias("prop_synthetic"))
    return profile.shown_categories(shares)


@query("divergence_matrix", "SELECT lang, CAST(sum(n_chars) FILTER (quality = 1) AS BIGINT) AS \"1\", CAST(sum(n_chars) FILTER (quality = 0) AS BIGINT) AS \"0\" FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def divergence_matrix(spark, sf_dir):
    sums = _arms(spark, sf_dir)[0].groupBy("lang", "quality").agg(F.sum("n_chars").alias("n"))
    return divergence.matrix(sums, "lang", "quality", "n", [1, 0])


_JUDGE = "SELECT item, CASE WHEN item % 5 = 0 THEN NULL ELSE ['1', '2', '12'][1 + (item * 3) % 3 + item % 2] END AS judge_vote FROM (SELECT DISTINCT item FROM (" + _VOTES + "))"


@query(
    "judge_panel_kappa",
    f"""WITH p AS (SELECT item, {_VERDICT.format("a", "b", "c")} AS panel FROM ({_COUNTS}) WHERE a + b + c >= 2),
    r AS (SELECT judge_vote AS x, panel AS y FROM p JOIN ({_JUDGE}) USING (item) WHERE judge_vote IS NOT NULL),
    k AS (SELECT count(*) AS n, avg((x = y)::int) AS agreement, avg((x = '1')::int) * avg((y = '1')::int) + avg((x = '2')::int) * avg((y = '2')::int) + avg((x = '12')::int) * avg((y = '12')::int) AS chance FROM r)
    SELECT n, round(agreement, 9) AS agreement, round(CASE WHEN chance >= 1 THEN 1 ELSE (agreement - chance) / (1 - chance) END, 9) AS kappa FROM k""",
)
def judge_panel_kappa(spark, sf_dir):
    votes = _votes(spark, sf_dir)
    names = F.array(*map(F.lit, ("1", "2", "12")))
    judged = votes.select("item").distinct().withColumn("judge_vote", F.when(F.col("item") % 5 != 0, F.element_at(names, (1 + F.col("item") * 3 % 3 + F.col("item") % 2).cast("int"))))
    return judge.judge_against_panel(votes, judged, "item", "vote", "judge_vote").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query(
    "chosen_margins",
    """WITH h AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '12' ELSE CAST(1 + user_id % 2 AS VARCHAR) END AS vote, event_id % 5 + 1 AS h1, (event_id * 3) % 5 + 1 AS h2, user_id % 5 + 1 AS j1, (event_id + user_id) % 5 + 1 AS j2 FROM events WHERE event_id % 4 <> 0),
    s AS (SELECT CASE WHEN vote = '1' THEN 1 ELSE -1 END AS sign, h1 - h2 AS h, j1 - j2 AS j, event_id FROM h WHERE vote <> '12')
    SELECT 'Clarity' AS criterion, round(avg(sign * j), 9) AS judge_diff, count(*) AS judge_n, round(avg(sign * h), 9) AS human_diff, count(*) AS human_n FROM s
    UNION ALL SELECT 'Fairness', round(avg(sign * j), 9), count(*), NULL, 0 FROM s""",
)
def chosen_margins(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    of = lambda clarity, fairness: F.create_map(F.lit("Clarity"), clarity.cast("string"), F.lit("Fairness"), fairness.cast("string"))
    rows = t(spark, sf_dir, "events")
    vote = F.when(u % 3 == 0, "12").otherwise((1 + u % 2).cast("string"))
    humans = rows.select(e, vote.alias("vote"), of(e % 5 + 1, F.lit("n/a")).alias("first"), of(e * 3 % 5 + 1, F.lit("4.0")).alias("second"))
    judged = rows.select(e, F.when(e % 4 != 0, "1").alias("judge_vote"), of(u % 5 + 1, u % 5 + 1).alias("first"), of((e + u) % 5 + 1, (e + u) % 5 + 1).alias("second"))
    out = judge.chosen_margins(humans, judged, "event_id").where("judge_n > 0")
    return out.select("criterion", F.round("judge_diff", 9).alias("judge_diff"), "judge_n", F.round("human_diff", 9).alias("human_diff"), "human_n")


@query("score_deviation")
def score_deviation(spark, sf_dir):
    tags = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_orderpriority").alias("example_tags"))
    return rubric.bootstrap_deviation(rubric.tag_scores(_graded(spark, sf_dir), "l_orderkey", tags), "tag")


_MESSAGES = """SELECT conv_id, '[' || string_agg('{"content": ' || to_json(text) || ', "role": ' || to_json(role) || '}', ', ' ORDER BY turn) || ']' AS m FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id"""


@query("message_list_keys", f"SELECT conv_id, 't0.0_n16_' || sha256(m) AS key FROM ({_MESSAGES})")
def message_list_keys(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").where("text is not null and role is not null")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy("conv_id").agg(turns.alias("m")).select("conv_id", generation.prompt_key(generation.messages_json("m"), 0.0, 16).alias("key"))


@query(
    "record_filters",
    f"""WITH p AS ({_PAIRS}), r AS (SELECT *, coalesce(question, '') || coalesce(answer, '') AS body, CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 4 = 1 THEN 'B' END AS label FROM p)
    SELECT conv_id, question IS NOT NULL AND answer IS NOT NULL AS complete, coalesce(length(body) >= 40 AND conv_id % 9 <> 0, false) AS valid, nullif(question, '') IS NOT NULL AS prompt,
      {_TOKENS.format("body")} <= 60 AS within, coalesce(label, '') <> '' AND conv_id % 2 = 0 IS NOT TRUE AS again FROM r""",
)
def record_filters(spark, sf_dir):
    label = F.when(F.col("conv_id") % 4 == 0, "").when(F.col("conv_id") % 4 == 1, "B")
    rows = first_turn_pairs(spark, sf_dir).withColumn("full_text", F.concat(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
    rows = rows.withColumns({"parse_failed": F.lit(False), "id": F.when(F.col("conv_id") % 9 == 0, "x_None").otherwise("x_1"), "prompt": F.lit(None).cast("string"), "label": label, "match": F.col("conv_id") % 2 == 0})
    return rows.select(
        "conv_id",
        profile.is_complete().alias("complete"),
        F.coalesce(profile.is_valid(strict=True), F.lit(False)).alias("valid"),
        profile.has_prompt().alias("prompt"),
        generation.within_budget("full_text", 60).alias("within"),
        generation.to_retry(2, False, "label", "match").alias("again"),
    )


_FIELDS = (" Cardiology", "general medicine", "Public-Health", "astrology")


@query(
    "metadata_parse",
    f"""WITH r AS (SELECT doc_id, {list(_FIELDS)}[1 + doc_id % 4] AS s, doc_id % 7 AS d, doc_id % 5 = 0 AS broken FROM documents)
    SELECT doc_id, NOT broken AS ok, CASE WHEN broken THEN NULL ELSE ['cardiology', 'general_medicine', 'public_health', 'unspecified'][1 + doc_id % 4] END AS specialty,
      CASE WHEN NOT broken AND d BETWEEN 1 AND 5 THEN CAST(d AS INT) END AS difficulty, CASE WHEN broken THEN NULL ELSE 'other' END AS question_type FROM r""",
)
def metadata_parse(spark, sf_dir):
    field = F.element_at(F.array(*map(F.lit, _FIELDS)), (1 + F.col("doc_id") % 4).cast("int"))
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct(field.alias("specialty"), F.concat((F.col("doc_id") % 7).cast("string"), F.lit(".6")).alias("difficulty"), F.lit("} {").alias("geography"))))
    replies = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.left(reply, F.lit(20))).otherwise(reply).alias("reply"))
    records = replies.select("id", F.lit(False).alias("is_document"), F.lit("x").alias("raw"))
    m = F.col("analysis_metadata")
    return metadata.tagged(records, replies).select(F.col("id").alias("doc_id"), m["_parse_ok"].alias("ok"), m["specialty"].alias("specialty"), m["difficulty"].alias("difficulty"), m["question_type"].alias("question_type"))


@query("subword_candidates")
def subword_candidates(spark, sf_dir):
    """Candidates by pre-tokens of letters, digits and marks: another tokenizer than white space."""
    parts = lambda x: F.regexp_extract_all(F.coalesce(x if not isinstance(x, str) else F.col(x), F.lit("")), F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"), F.lit(0))
    return decontam.candidates(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), "doc_id", "item_id", 13, parts)
