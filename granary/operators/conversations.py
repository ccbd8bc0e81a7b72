"""Turns of conversations and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import strip

USER, ASSISTANT = ("human", "user"), ("assistant", "gpt", "ai")
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system"}
HEAD, TAIL, LONG, MARK = 4000, 2000, 6200, "\n\n[...]\n\n"


def first_turn(conversation: str, roles: tuple[str, ...]) -> Column:
    """The first value, not null, of a role in any case (PRJ1)."""
    return F.get(F.filter(conversation, lambda t: F.lower(t["from"]).isin(*roles) & t["value"].isNotNull()), F.lit(0))["value"]


def first_pairs(turns: DataFrame, key: str) -> DataFrame:
    """(key, question, answer, full_text) from one row for each turn (key, turn, role, text): PRJ1 and PRJ4 by aggregation alone."""
    role = F.lower("role")
    of = lambda roles: F.min_by("text", F.when(role.isin(*roles) & F.col("text").isNotNull(), F.col("turn")))
    return turns.groupBy(key).agg(of(USER).alias("question"), of(ASSISTANT).alias("answer")).withColumn("full_text", full_text("question", "answer"))


def turn_places(conversation: str) -> Column:
    """Places of the first user turn and of the first ``assistant`` turn after it (PRJ2)."""
    user = F.expr(f"array_min(filter(transform({conversation}, (t, i) -> if(t.`from` in ('human', 'user'), i, null)), i -> i is not null))")
    answer = F.expr(f"array_min(filter(transform({conversation}, (t, i) -> if(t.`from` = 'assistant', i, null)), i -> i > array_min(filter(transform({conversation}, (u, j) -> if(u.`from` in ('human', 'user'), j, null)), j -> j is not null))))")
    return F.struct(user.alias("user"), answer.alias("assistant"))


def full_text(*parts: str) -> Column:
    """Parts that aren't empty, with a blank line between them (PRJ4)."""
    return strip(F.array_join(F.filter(F.array(*map(F.col, parts)), lambda x: x.isNotNull() & (x != "")), "\n\n"))


def without_system(conversation: str) -> Column:
    return F.filter(conversation, lambda t: t["from"].isNull() | (t["from"] != "system"))


def prepared(rows: DataFrame, conversation: str = "conversations") -> DataFrame:
    """Rows before the first attempt (PRJ7): no system turns, exact_match false and try_count 0 where they aren't set."""
    old = lambda name, kind, value: F.coalesce(F.col(name).cast(kind), F.lit(value)) if name in rows.columns else F.lit(value)
    return rows.withColumns({conversation: without_system(conversation), "exact_match": old("exact_match", "boolean", False), "try_count": old("try_count", "int", 0)})


def document_body(text: str) -> Column:
    """Head and tail of a long document with a mark between them (PRJ9)."""
    t = F.col(text)
    return F.when(F.length(t) > LONG, F.concat(F.left(t, F.lit(HEAD)), F.lit(MARK), F.right(t, F.lit(TAIL)))).otherwise(t)


def qa_body(question: str, answer: str, most: int = 2000) -> Column:
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.left(F.col(x), F.lit(most)), F.lit("..."))).otherwise(F.col(x))
    return F.concat(F.lit("QUESTION:\n"), F.coalesce(cut(question), F.lit("")), F.lit("\n\nANSWER:\n"), F.coalesce(cut(answer), F.lit("")))


def messages(system: str | Column, user: Column) -> Column:
    """Chat messages of a system and a user turn (PRJ10)."""
    system = F.lit(system) if isinstance(system, str) else system
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


# The marks that replies are parsed by (functions.text).
EXAMPLE, QUESTION, ANSWER = "--- Example {} ---\n", "<question>", "<answer>"
#: What is asked for after the examples: pairs with options, open pairs, or a question alone.
REQUESTS = {
    "labelled": "Write one new multiple-choice question with its answer, between the same tags.",
    "open": "Write one new open question with its answer, between the same tags.",
    "question": "Write one new question between <question> and </question>.",
}


def few_shot_prompt(shots: DataFrame, key: str, variant: str = "labelled", requests: dict[str, str] = REQUESTS) -> DataFrame:
    """One prompt for each target from its drawn examples (shot, question, answer), in the order of the draw, and a request by variant (PRJ13)."""
    begin, end = (F.lit(x) for x in EXAMPLE.split("{}"))
    body = F.concat(F.lit(f"{QUESTION}\n"), "question", F.lit("\n</question>\n\n")) if variant == "question" else F.concat(F.lit(QUESTION), "question", F.lit(f"\n{ANSWER}"), "answer", F.lit("\n\n"))
    entry = F.struct("shot", F.concat(begin, (F.col("shot") + 1).cast("string"), end, body).alias("s"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]), "")  # k examples a target
    return shots.groupBy(key).agg(F.concat(shown, F.lit(requests[variant])).alias("prompt"))


def guideline_prompt(text: str | Column, items: int = 10) -> Column:
    """A guideline and the request for so many questions on it, in the blocks that ``text.qa_blocks`` reads (PRJ14)."""
    wanted = f"\n\nWrite {items} multiple-choice questions that this text alone answers, each in a block of its own:\n<qa>\n<question>case, question and options A) to E)</question>\n<answer>reasons, then Answer: letter</answer>\n</qa>"
    return F.concat(F.lit("Guideline:\n\n"), F.col(text) if isinstance(text, str) else text, F.lit(wanted))


def synthetic_row(question: str, answer: str, label: str) -> Column:
    """A generated pair as a conversation with its label (PRJ15)."""
    turn = lambda who, x: F.struct(F.lit(who).alias("from"), F.col(x).alias("value"))
    return F.struct(F.array(turn("human", question), turn("assistant", answer)).alias("conversations"), F.col(label).alias("label_letter"), F.col(label).isNotNull().alias("is_labeled"))


def with_roles(conversation: str) -> Column:
    """Turns as (role, content) under the names that training expects (PRJ22)."""
    roles = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.transform(conversation, lambda t: F.struct(F.element_at(roles, t["from"]).alias("role"), t["value"].alias("content")))


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all sources; columns that one lacks are null (SET1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
