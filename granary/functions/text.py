"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.vocabulary import CONTINENT_OF, GEOGRAPHY_ALIASES


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: str | Column) -> Column:
    """White-space tokens; null and blank give none (FN1)."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda x: x != "")


def strip(x: str | Column) -> Column:
    """Without white space at either end."""
    return F.btrim(col(x), F.lit(" \t\n\x0b\x0c\r"))


def n_tokens(text: str | Column) -> Column:
    return F.size(tokens(text)).cast("long")


def is_mcq(text: str | Column) -> Column:
    """At least two of the markers ``A)`` to ``E)`` are there (FLT1); null is false."""
    marks = sum((F.contains(col(text), F.lit(f"{x})")).cast("int") for x in "ABCDE"), F.lit(0))
    return F.coalesce(marks >= 2, F.lit(False))


def has_think_block(text: str | Column) -> Column:
    """Both the opening and the closing tag are there (FLT2)."""
    return F.coalesce(F.contains(col(text), F.lit("<think>")) & F.contains(col(text), F.lit("</think>")), F.lit(False))


FINAL, CONTROL = "<|channel|>final<|message|>", "<|"


def unwrapped(text: str | Column) -> Column:
    """The first final-channel segment, without a thinking part, and of that the first code fence's contents (FN2)."""
    out = col(text)
    tail = F.when(F.instr(out, FINAL) > 0, F.substring_index(F.substring(out, F.instr(out, FINAL) + len(FINAL), F.length(out)), CONTROL, 1)).otherwise(out)
    tail = F.when(F.instr(tail, "</think>") > 0, F.substring(tail, F.instr(tail, "</think>") + len("</think>"), F.length(tail))).otherwise(tail)
    fence = F.regexp_extract(tail, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return strip(F.when(fence != "", fence).otherwise(tail))


def final_channel(text: str | Column) -> Column:
    """What follows the last final-channel marker; the whole text without one (FN3)."""
    return F.substring_index(col(text), FINAL, -1)


def normal_geography(x: str | Column) -> Column:
    """Lower-cased and trimmed; spellings of nothing become ``unspecified`` (FN8)."""
    v = F.lower(F.trim(F.coalesce(col(x), F.lit(""))))
    return F.when(v.isin("", *GEOGRAPHY_ALIASES), "unspecified").otherwise(v)


def continent(x: str | Column, word_boundary: bool = False) -> Column:
    """One of eight bins (FN9): an exact name, else the first name, in the table's order, that occurs in the value.

    ``word_boundary`` asks for whole words, so that "us" isn't found in "australia".
    """
    v = normal_geography(x)
    pairs = list(CONTINENT_OF.items())
    exact = F.create_map(*(F.lit(y) for pair in pairs for y in pair))
    entries = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(place).alias("place")) for name, place in pairs))
    found = (lambda e: F.regexp_like(v, F.concat(F.lit(r"(?<!\w)"), e["name"], F.lit(r"(?!\w)")))) if word_boundary else (lambda e: F.contains(v, e["name"]))
    hit = F.get(F.filter(entries, found), F.lit(0))["place"]
    return F.when(v == "unspecified", "unspecified").otherwise(F.coalesce(F.element_at(exact, v), hit, F.lit("other")))


def enum(x: str | Column, allowed: tuple[str, ...], default: str = "unspecified") -> Column:
    """Trimmed, lower-cased, blanks and hyphens as underscores; the default outside ``allowed`` (FLT11)."""
    v = F.translate(F.lower(F.trim(col(x))), " -", "__")
    return F.when(v.isin(*allowed), v).otherwise(default)


def difficulty(x: str | Column) -> Column:
    """A whole number from 1 to 5 (fractions cut off), else null (FN7)."""
    v = col(x).try_cast("double")
    whole = F.when(v.between(-1e9, 1e9), F.floor(v)).cast("int")
    return F.when(whole.between(1, 5), whole)


def safe_int(x: str | Column) -> Column:
    """Whole numbers only: "4.0" is null (FN17)."""
    return F.when(F.trim(col(x).cast("string")).rlike(r"^[+-]?[0-9]+$"), F.trim(col(x).cast("string")).try_cast("int"))


# The patterns of answer letters, in the order in which they are tried, and the name each goes by.
# In the second, runs are possessive: they never end before a letter of the range, so nothing is lost.
EXACT_PATTERNS = (
    (r"(?i)answer is \(?([A-J])\)?", "mmlu_pro"),
    (r"(?i)answer[^A-J]*+(?:boxed)*+[^A-J]*+([A-J])\b", "medmcqa"),
)
CHOSEN_PATTERNS = (
    r"answer is \(?([A-J])\)?",
    r"(?i)answer[^A-E]*+(?:boxed)*+[^A-E]*+([A-E])\b",
    r"\*\*\s*([A-E])\s*[.\-\x{2013}]",
    r"(?i)option\s*([1-5])",
)
INVALID, UNKNOWN = "INVALID", "Unknown"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _letter(text: str | Column) -> Column:
    """The letter of the first pattern that is found (its last match) and the pattern's name, else INVALID and null."""
    t = F.coalesce(col(text), F.lit(""))
    out = F.struct(F.lit(INVALID).alias("found"), F.lit(None).cast("string").alias("pattern"))
    for pattern, name in reversed(EXACT_PATTERNS):
        hits = _all(t, pattern)
        out = F.when(F.size(hits) > 0, F.struct(F.upper(F.get(hits, F.size(hits) - 1)).alias("found"), F.lit(name).alias("pattern"))).otherwise(out)
    return out


def exact_letter(text: str | Column) -> Column:
    """The answer letter A to J, else INVALID (FN10)."""
    return _letter(text)["found"]


def exact_match(text: str | Column, label: str | Column) -> Column:
    """(exact_match, found, pattern) of a reply against its label; all null without a label (FN10)."""
    of, label = _letter(text), F.nullif(col(label), F.lit(""))
    got = F.struct((of["found"] == F.upper(label)).alias("exact_match"), of["found"].alias("found"), of["pattern"].alias("pattern"))
    none = F.struct(F.lit(None).cast("boolean").alias("exact_match"), F.lit(None).cast("string").alias("found"), F.lit(None).cast("string").alias("pattern"))
    return F.when(label.isNotNull(), got).otherwise(none)


def chosen_letter(text: str | Column) -> Column:
    """The chosen option in four steps, each the next one's stand-in, else Unknown (FN11): the last letter of a
    sentence that says so, the last after "answer", the first bold one with a mark, the number of the first option."""
    t = F.coalesce(col(text), F.lit(""))
    said, after, bold, option = (_all(t, x) for x in CHOSEN_PATTERNS)
    last = lambda hits: F.when(F.size(hits) > 0, F.upper(F.get(hits, F.size(hits) - 1)))
    first = lambda hits: F.get(hits, F.lit(0))
    return F.coalesce(last(said), last(after), first(bold), F.chr(F.lit(64) + first(option).try_cast("int")), F.lit(UNKNOWN))


def tagged(text: str | Column, tag: str) -> Column:
    """Contents of the first ``<tag>`` block, trimmed; null without one or if blank (FN14)."""
    found = strip(F.regexp_extract(col(text), rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    return F.when(found != "", found)


# Where a question may end, where an answer begins, and a block of both.
QUESTION_PATTERN = r"(?is)<question>(.*?)(?:</question>|<answer>|---\s*Answer\s*---)"
ANSWER_PATTERN = r"(?is)(?:<answer>|---\s*Answer\s*---)(.*)"
BLOCK_PATTERN = r"(?is)<qa>\s*<question>(.*?)</question>\s*<answer>(.*?)</answer>\s*</qa>"


def question_answer(text: str | Column) -> Column:
    """(question, answer) of a reply; null unless both are there (FN12). An answer goes on to the end, its closing tag left out."""
    t = col(text)
    question = strip(F.regexp_extract(t, QUESTION_PATTERN, 1))
    answer = strip(F.regexp_replace(strip(F.regexp_extract(t, ANSWER_PATTERN, 1)), r"(?i)</answer>$", ""))
    return F.when((question != "") & (answer != ""), F.struct(question.alias("question"), answer.alias("answer")))


def qa_blocks(text: str | Column) -> Column:
    """All blocks of a question and an answer, neither of them blank, as an array of (question, answer) (FN13)."""
    q, a = (F.transform(F.regexp_extract_all(col(text), F.lit(BLOCK_PATTERN), F.lit(i)), strip) for i in (1, 2))
    return F.filter(F.zip_with(q, a, lambda x, y: F.struct(x.alias("question"), y.alias("answer"))), lambda p: (p["question"] != "") & (p["answer"] != ""))


def retry_temperature(base: float | Column, attempt: str | Column) -> Column:
    return F.least(F.lit(1.0), F.lit(base) + 0.2 * col(attempt))


def jsd_label(x: str | Column) -> Column:
    """How large a divergence is, in words (FN19)."""
    v = col(x)
    return F.when(v < 0.05, "near-identical").when(v < 0.15, "small shift").when(v < 0.30, "moderate shift").when(v < 0.50, "large shift").otherwise("severe shift")


def seed_of(*parts: str | Column) -> Column:
    """The first four bytes, as a number, of the SHA-256 of the parts, each ended by a zero byte (FN20)."""
    joined = F.concat(*(F.concat(p if isinstance(p, Column) else F.lit(p), F.lit("\0")) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long")


def short_count(x: str | Column) -> Column:
    """1234567 as 1.2M, 12345 as 12.3k (FN21)."""
    v = col(x)
    return F.when(v >= 1_000_000, F.concat(F.format_string("%.1f", v / 1e6), F.lit("M"))).when(v >= 1000, F.concat(F.format_string("%.1f", v / 1e3), F.lit("k"))).otherwise(v.cast("string"))


def pretty(x: str | Column) -> Column:
    return F.initcap(F.replace(col(x), F.lit("_"), F.lit(" ")))


def file_name(x: str | Column) -> Column:
    return F.regexp_replace(col(x), r"[^A-Za-z0-9._-]", "_")


def duration(seconds: str | Column) -> Column:
    """HH:MM:SS (FN23)."""
    s = col(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def lines(text: str | Column) -> Column:
    return F.split(F.coalesce(col(text), F.lit("")), "\n")


def exit_code(text: str | Column) -> Column:
    """The leading digits behind the last line's ``Exit code: ``; null without any (FN26)."""
    last = F.get(F.reverse(F.filter(lines(text), lambda x: F.contains(x, F.lit("Exit code:")))), F.lit(0))
    code = F.regexp_extract(F.get(F.split(last, "Exit code: "), F.lit(1)), r"^([0-9]*)", 1)
    return F.nullif(code, F.lit(""))


def log_status(text: str | Column) -> Column:
    """COMPLETED, FAILED with the exit code, or UNKNOWN (FN26)."""
    code = exit_code(text)
    return F.when(code == "0", "COMPLETED").when(code.isNotNull(), F.concat(F.lit("FAILED (exit code "), code, F.lit(")"))).otherwise("UNKNOWN")


# What a log is searched for, in this order, in either case.
CAUSES = (
    ("OOM", r"cuda out of memory|cudnn_status_alloc_failed|cublas_status_alloc_failed|out of memory"),
    ("NAN", r"\bnan\b|loss is nan|nan loss"),
    ("FD_LIMIT", r"too many open files|errno 24"),
    ("FINISHED", r"training finished|training completed"),
)
# The lines that count as errors after a traceback, and without one.
TRACEBACK, RAISED, REPORTED = "Traceback", r"(Error|Exception)", r"ERROR:|Error:|FAILED|exit code: [1-9]"


def log_cause(text: str | Column) -> Column:
    """OOM, NAN, FD_LIMIT, FINISHED or IDK, by the first that fits (FN26)."""
    t = F.coalesce(col(text), F.lit(""))
    out = F.lit("IDK")
    for name, pattern in reversed(CAUSES):
        out = F.when(t.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def last_error(text: str | Column) -> Column:
    """The last line with an error from the first traceback on, else the first line that reports one, else UNKNOWN (FN27)."""
    every = lines(text)
    begins = F.array_position(F.transform(every, lambda x: F.contains(x, F.lit(TRACEBACK))), F.lit(True))
    raised = F.filter(F.slice(every, F.greatest(begins, F.lit(1)).cast("int"), F.size(every)), lambda x: x.rlike(RAISED))
    reported = F.filter(every, lambda x: x.rlike(REPORTED))
    return F.coalesce(F.when(begins > 0, F.get(F.reverse(raised), F.lit(0))), F.get(reported, F.lit(0)), F.lit("UNKNOWN"))


def model_path(text: str | Column) -> Column:
    """The rest of the first line with ``MODEL_PATH=``, else the last ``pretrained=`` of the first line with one, else UNKNOWN (FN28)."""
    with_mark = lambda mark: F.get(F.filter(lines(text), lambda x: F.contains(x, F.lit(mark))), F.lit(0))
    path = F.regexp_extract(with_mark("MODEL_PATH="), r"MODEL_PATH=(.*)", 1)
    given = F.regexp_extract(with_mark("pretrained="), r".*pretrained=([^, ]+)", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(given, F.lit("")), F.lit("UNKNOWN"))


# A progress bar, and the trainer's numbers.
PROGRESS = r"[0-9]{1,3}%\|[^|]*\|[ \t]*[0-9]+/[0-9]+[ \t]*\[[^\]]+\]"
LOSS, EPOCH, CLOCK = r"'loss':[ \t]*[0-9.]+", r"'epoch':[ \t]*[0-9.]+", r"[0-9]{2}:[0-9]{2}:[0-9]{2}"


def last_hit(text: str | Column, pattern: str) -> Column:
    """The last match of a pattern in a text; null without one (WIN8)."""
    return F.get(F.reverse(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"({pattern})"), F.lit(1))), F.lit(0))


def elapsed(text: str | Column) -> Column:
    """The last time of the lines that tell what has elapsed; null without one (WIN8)."""
    told = F.array_join(F.filter(lines(text), lambda x: F.contains(F.lower(x), F.lit("elapsed"))), "\n")
    return last_hit(told, CLOCK)


def training_state(text: str | Column) -> Column:
    """(cause, elapsed, progress, loss, epoch): progress and numbers only where the run neither finished nor tells its time (WIN8)."""
    cause, time = log_cause(text), elapsed(text)
    running = (cause != "FINISHED") & time.isNull()
    of = lambda pattern: F.when(running, last_hit(text, pattern))
    return F.struct(cause.alias("cause"), time.alias("elapsed"), of(PROGRESS).alias("progress"), of(LOSS).alias("loss"), of(EPOCH).alias("epoch"))


# The marks of a code fence around a JSON reply.
FENCE = r"^```json\s*|\s*```$"


def fenced_json(text: str | Column) -> Column:
    """A reply's JSON without its code fence, as a variant; null where it isn't JSON (FN5)."""
    return F.try_parse_json(F.regexp_replace(strip(text), FENCE, ""))


def criteria_met(text: str | Column) -> Column:
    """A grader's verdict, true or false; null where the reply doesn't say so (FN5, ITR3)."""
    reply = fenced_json(text)
    return F.when(F.schema_of_variant(F.try_variant_get(reply, "$.criteria_met", "variant")) == "BOOLEAN", F.try_variant_get(reply, "$.criteria_met", "boolean"))
