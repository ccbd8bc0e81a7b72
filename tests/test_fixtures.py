"""Small cases with results worked out by hand."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.functions import parsing, text
from granary.operators import conversations, decontam, divergence, generation, judge, logs, profile, rubric, sampling
from granary.plans import registry
from granary.sources import readers, sinks


def one(spark, expression, **values):
    return spark.createDataFrame([Row(**values)]).select(expression.alias("x")).first()["x"]


def many(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f("v").alias("x")).orderBy("i").collect()]


def test_divergence(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.25), ("b", 0.5, 0.25), ("c", 0.0, 0.5)], "category string, p double, q double")
    jsd, tv = rows.agg(divergence.jensen_shannon(), divergence.total_variation()).first()
    assert round(jsd, 12) == 0.311278124459 and tv == 0.5
    same, apart = (spark.createDataFrame(x, "p double, q double").agg(divergence.jensen_shannon()).first()[0] for x in ([(0.5, 0.5)] * 2, [(1.0, 0.0), (0.0, 1.0)]))
    assert (same, apart) == (0.0, 1.0)
    assert math.isclose(divergence.shares_jsd(np.array([0.5, 0.5, 0]), np.array([0.25, 0.25, 0.5])), jsd)


def test_wasserstein(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("b", 5)], "arm string, v int")
    assert math.isclose(divergence.wasserstein(rows, "arm", "v", "a", "b").first()[0], 4 / 3)
    assert math.isnan(divergence.wasserstein(rows, "arm", "v", "a", "none").first()[0])


def test_bca():
    low, high = divergence.bca(np.arange(50), seed=3)
    assert 18 < low < 24.5 < high < 31
    assert divergence.bca(np.ones(5)) == (1.0, 1.0) and math.isnan(divergence.bca(np.array([]))[0])


def test_kappa(spark):
    rows = spark.createDataFrame(list(zip(["1", "1", "2", "12", "2"], ["1", "2", "2", "12", "1"], strict=True)), "a string, b string")
    got = judge.kappa(rows, "a", "b", []).first()
    assert [round(got[x], 9) for x in ("agreement", "chance", "kappa")] == [0.6, 0.36, 0.375]


def test_panel(spark):
    votes = [(0, "1"), (0, "1"), (0, "2"), (1, "1"), (1, "2"), (2, "12"), (4, "1"), (4, "1"), (4, "2"), (4, "2")]
    got = {r["item"]: r["verdict"] for r in judge.panel(spark.createDataFrame(votes, "item int, vote string"), "item", "vote").collect()}
    assert got == {0: "1", 1: "12", 2: "12", 4: "12"}


def test_win_rates(spark):
    rows = spark.createDataFrame([(w,) for w in ["Model 1"] * 2 + ["Model 2"] * 3 + ["Tie", "Unknown"]], "w string")
    got = judge.win_rates(rows, "w").first()
    assert (got["n_total"], got["n_decided"], got["win_2"]) == (7, 6, 0.5)
    assert math.isclose(got["net"], 1 / 6) and math.isclose(got["adjusted"], 3.5 / 6)


def test_judge_reply(spark):
    both = "\n".join(f"{c}: {i % 5 + 1}" for i, c in enumerate(judge.CRITERIA))
    reply = f"Model 1 Scores:\n{both}\nModel 2 Scores:\n{both.replace('Fairness: 5', 'n/a')}\nReasoning: because\nof it\nwinner: model 2"
    got = one(spark, judge.parsed("v"), v=reply)
    assert got["winner"] == "Model 2" and got["reasoning"].endswith("because\nof it")
    assert got["model_1_scores"]["Fairness"] is None and got["model_2_scores"]["Relevance & completeness"] == 3
    assert one(spark, judge.winner_of("v"), v="none") == "Unknown"
    rows = spark.createDataFrame([(w, s) for w in (*judge.WINNERS, "Unknown") for s in (True, False)], "w string, s boolean")
    codes = [r[0] for r in rows.select(judge.vote_code(judge.unswapped("w", "s"))).collect()]
    assert codes == ["2", "1", "1", "2", "12", "12", None, None]


def test_alignment(spark):
    train = "a b c d e f g h i j x x x k l m n o p".split()
    item = "a b c d e f g h i j y k l m n z z z z z".split()
    assert parsing.match_ratio(train, item) == 0.5 and parsing.match_ratio(train, []) == 0.0
    docs = spark.createDataFrame([(1, " ".join(train)), (2, "q r s"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    pairs = decontam.candidates(docs, items, "doc_id", "item_id")
    assert [tuple(r) for r in decontam.verified(pairs, docs, items, "doc_id", "item_id").collect()] == [(1, 9, 0.5)]
    assert decontam.verified(pairs, docs, items, "doc_id", "item_id", 0.51).count() == 0


def test_ngrams(spark):
    for n, plain, tail in ((7, 0, 0), (8, 0, 1), (9, 1, 2)):
        rows = spark.createDataFrame([([str(i) for i in range(n)],)], "t array<string>")
        assert [rows.select(F.size(decontam.ngrams("t", 8, x))).first()[0] for x in (False, True)] == [plain, tail]


def test_sampling(spark):
    rows = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    for parts in (1, 5):
        assert [r["id"] for r in rows.repartition(parts).orderBy(sampling.stable_key(42, "id")).collect()] == list("edbca")
    assert {r["id"] for r in sampling.bottom(rows, 2, "id", 42).collect()} == {"e", "d"}
    assert sampling.bottom(rows, -1, "id").count() == 5 and sampling.bottom(rows, 0, "id").count() == 0
    takes = lambda sizes, n: [r["take"] for r in sampling.allocation(spark.createDataFrame(list(enumerate(sizes)), "stratum int, size long"), n).orderBy("stratum").collect()]
    assert takes([70, 20, 9, 1], 10) == [5, 2, 2, 1]
    assert takes([3, 3, 3], 2) == [1, 1, 0] and takes([2, 1], 9) == [2, 1]
    strata = spark.createDataFrame([(i, None if i % 4 == 0 else str(i % 2)) for i in range(40)], "id int, s string")
    assert sampling.stratified(strata, 12, "s", "id").count() == 12


def test_few_shot(spark):
    targets = spark.createDataFrame([(i,) for i in range(20)], "id int")
    pool = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(7)], "example int, question string, answer string")
    shots = sampling.few_shot(targets, pool, "id")
    assert shots.groupBy("id").agg(F.countDistinct("example").alias("n")).where("n <> 5").count() == 0
    assert "--- Example 1 ---" in conversations.few_shot_prompt(shots, "id").first()["prompt"]


def test_rubric(spark):
    graded = spark.createDataFrame([("x", 5.0, True, ["a"]), ("x", 3.0, False, ["b"]), ("x", -2.0, True, []), ("y", -1.0, True, [])], "k string, points double, met boolean, tags array<string>")
    assert {r["k"]: r["score"] for r in rubric.scores(graded, "k").collect()} == {"x": 0.375, "y": None}
    tags = spark.createDataFrame([("x", ["a", "t"])], "k string, example_tags array<string>")
    got = {(r["k"], r["tag"]): r["score"] for r in rubric.tag_scores(graded, "k", tags).collect()}
    assert got[("x", "a")] == 1.0 and got[("x", "t")] == 0.375 and got[("x", "b")] == 0.0
    assert rubric.clipped_means(spark.createDataFrame([(-0.5,), (0.2,)], "score double")).first()["mean"] == 0.0


def test_letters(spark):
    replies = ["the answer is (b). No: answer is C", r"\boxed{D}", "hm", None]
    assert many(spark, text.exact_letter, replies) == ["C", "INVALID", "INVALID", "INVALID"]
    assert many(spark, text.chosen_letter, ["answer is A", "Answer: c", "**B.** it is", "**B** it is", "option  2", "?"]) == ["A", "C", "B", "Unknown", "B", "Unknown"]
    replies = ["Answer: **B**", "Answer\nB", "The answer is $\\boxed{C}$", "answer: none"]
    assert many(spark, text.exact_letter, replies) == ["B", "B", "INVALID", "E"]
    assert tuple(one(spark, text.exact_match("v", F.lit("b")), v="Answer: B")) == (True, "B", "medmcqa")
    assert tuple(one(spark, text.exact_match("v", F.lit("")), v="Answer: B")) == (None, None, None)


def test_balanced_json():
    for given, want in (('x {"a": "}"} y', {"a": "}"}), ('{"a": "\\"{"}', {"a": '"{'}), ('{"a": {"b": 1}} {', {"a": {"b": 1}}), ("{", None), ("{a}", None), (None, None)):
        assert parsing.first_object(given) == want


def test_metadata(spark):
    reply = json.dumps({"specialty": " General Medicine ", "question_type": "follow-up", "difficulty": "3.7", "severity": 7})
    got = parsing.metadata_of(f"Sure: {reply}", False)
    assert (got["specialty"], got["question_type"], got["difficulty"], got["severity"], got["_parse_ok"]) == ("general_medicine", "follow_up", 3, "unspecified", True)
    rows = spark.createDataFrame([(reply, False), ("no", True), (None, None)], "reply string, d boolean")
    assert [r[0] for r in rows.select(parsing.metadata("reply", "d")["_parse_ok"]).collect()] == [True, False, False]
    assert many(spark, text.difficulty, ["3", "4", "3.7", "0", "6", "x", None]) == [3, 4, 3, None, None, None, None]


def test_geography(spark):
    places = ["Peru", "rural Brazil", "rural Australia", "Atlantis", " ", "not specified", None]
    assert many(spark, text.continent, places) == ["americas", "americas", "americas", "other", "unspecified", "unspecified", "unspecified"]
    assert many(spark, lambda v: text.continent(v, True), ["rural Australia"]) == ["oceania"]


def test_flags(spark):
    assert many(spark, text.is_mcq, ["A) x B) y", "A) x", None]) == [True, False, False]
    assert many(spark, text.n_tokens, ["", " a  b ", "a b", None]) == [0, 2, 2, 0]
    assert many(spark, text.unwrapped, ["<think>x</think> y", "```json\n{}\n```", "a<|channel|>final<|message|>b<|end|>c"]) == ["y", "{}", "b"]
    assert many(spark, text.duration, [3661], "long") == ["01:01:01"]
    assert many(spark, text.safe_int, ["4", "4.0", "x"]) == [4, None, None]
    got = one(spark, text.qa_blocks("v"), v="<qa><question>a</question>\n<answer>b</answer></qa> x <qa><question> </question><answer>c</answer></qa><question>d</question><answer>e</answer>")
    assert [tuple(x) for x in got] == [("a", "b")]
    assert tuple(one(spark, text.question_answer("v"), v="<question>a<answer>b\nc")) == ("a", "b\nc")
    assert one(spark, text.seed_of("a", "b"), v=1) == divergence.seed_of("a", "b")


def test_turns(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "Human", None), (1, 2, "user", "q"), (1, 3, "gpt", "a"), (2, 0, "assistant", "b")], "id int, turn int, role string, text string")
    got = {r["id"]: tuple(r)[1:] for r in conversations.first_pairs(rows, "id").collect()}
    assert got == {1: ("q", "a", "q\n\na"), 2: (None, "b", "b")}
    talk = spark.createDataFrame([([("assistant", "x"), ("human", "q"), ("gpt", "y"), ("assistant", "z")],)], "c array<struct<from: string, value: string>>")
    assert tuple(talk.select(conversations.turn_places("c").alias("p")).first()["p"]) == (1, 3)
    assert talk.select(conversations.first_turn("c", conversations.ASSISTANT)).first()[0] == "x"


def test_bodies(spark):
    cut = lambda n: one(spark, conversations.document_body("v"), v="x" * n)
    assert len(cut(6200)) == 6200 and cut(6201) == "x" * 4000 + conversations.MARK + "x" * 2000
    assert "x..." in one(spark, conversations.qa_body("v", "v"), v="x" * 2001)


def test_votes():
    assert [parsing.voted_answer("r", v, "a", "b") for v in ("1", "2")] == ["a", "b"]
    assert parsing.voted_answer("r", "12", "a", "") == "a" and parsing.voted_answer("r", None, "a", "b") in "ab"


def test_attempts(spark):
    rows = [(1, 1, "x", False), (1, 2, "y", True), (1, 3, "z", True), *((2, i, str(i), False) for i in range(1, 9)), (3, 1, "u", None)]
    got = {r["id"]: (r["try_count"], r["exact_match"]) for r in generation.accepted(spark.createDataFrame(rows, "id int, attempt int, text string, match boolean"), "id").collect()}
    assert got == {1: (2, True), 2: (8, False), 3: (1, None)}


def test_cache(spark, tmp_path):
    prompts = spark.createDataFrame([("a", "p"), ("b", "q"), ("b", "q")], "key string, prompt string")
    cache = generation.latest(spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "key string, answer string, at int"), "at")
    assert [r["key"] for r in generation.missing(prompts, cache).collect()] == ["b"]
    # a model whose answers differ from call to call still gives both results the same ones
    got, after = generation.generate(prompts, cache, lambda rows: rows.select("key", F.uuid().alias("answer")), str(tmp_path / "answers"))
    answers = {r["key"]: r["answer"] for r in after.collect()}
    assert sorted(tuple(r) for r in got.select("key", "answer").collect()) == sorted([("a", "new"), ("b", answers["b"]), ("b", answers["b"])]) and len(answers) == 2


def test_logs(spark, tmp_path):
    table = "| Tasks |Version|Filter|n-shot|Metric|   |Value|   |Stderr|\n|---|---|---|---|---|---|---|---|---|\n"
    line = "|{} |{}|none|     0|acc   |x  |{}|+  |0.01|\n"
    body = "".join(line.format(*x) for x in (("pubmed", 1, 0.5), ("pubmed", 1, 0.7), (" - mmlu", 2, 0.25))) + "| |  |none| 0|prompt_level_strict_acc|x|0.75|+|0.1|\n"
    (tmp_path / "run.17.log").write_text("MODEL_PATH=/m\nExit code: 1\nTraceback\nValueError: bad\nCUDA out of memory\nloss nan\nExit code: 0\n" + table + body)
    (tmp_path / "run.18.log").write_text("elapsed 00:01:02\nTraceback\nValueError: bad\nExit code: -9\n")
    rows = logs.read_logs(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in logs.summary(rows).collect()}
    assert got == {"run.17.log": ("COMPLETED", "/m", None), "run.18.log": ("UNKNOWN", "UNKNOWN", "ValueError: bad")}
    assert logs.summary(rows, completed_only=True).count() == 1
    assert {r["cause"]: r["elapsed"] for r in logs.training(rows).collect()} == {"OOM": None, "IDK": "00:01:02"}
    assert logs.benchmark_row(logs.results(rows), {"medical": ["pubmed"], "general": ["mmlu", "ifeval", "none"]}).first()[1:] == (50.0, 50.0)
    (tmp_path / "results" / "m_17" / "deep").mkdir(parents=True)
    (tmp_path / "results" / "m_17" / "deep" / "samples_pubmed.jsonl").write_text("x [invalid] [INVALID]\ny\n")
    (tmp_path / "results" / "m_99").mkdir()
    (tmp_path / "results" / "m_99" / "samples_other.jsonl").write_text("[invalid]\n")
    found = logs.invalid_by_report(rows, logs.read_results(spark, str(tmp_path / "results")))
    assert sorted((r["job"], r["file"], r["n_invalid"], r["pct"]) for r in found.collect() if r["file"]) == [("17", "pubmed", 2, 100.0)] and found.count() == 2
    samples = spark.createDataFrame([("a", [["abcd"]]), ("a", [["ab"]]), ("a", [])], "path string, resps array<array<string>>")
    assert logs.response_lengths(samples).first()["mean_length"] == 3.0
    series = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 0.0)], "step long, loss double")
    assert sorted(map(tuple, logs.plot_grid(series, 2, 2).collect())) == [(0, 1), (1, 0), (1, 1)]
    state = spark.createDataFrame([(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 2}]}),)], "text string")
    assert [tuple(r) for r in logs.losses(state).collect()] == [(1, 2.0)]


def test_sources(spark, tmp_path):
    lines = tmp_path / "c.jsonl"
    lines.write_text('{"id": "1", "conversations": [{"from": "human", "value": "A) x B) y"}, {"from": "gpt", "value": "a"}]}\n\n{bad\n{"question": "q", "output": "o"}\n')
    got = sorted((r["question"], r["answer"], r["is_mcq"]) for r in readers.conversations(spark, str(lines), "curated", "source", "c").collect())
    assert got == [("A) x B) y", "a", True), ("q", "o", False)]
    assert readers.malformed(spark, str(lines)).count() == 1
    flat = tmp_path / "v.jsonl"
    flat.write_text('{"contribution_id": "r1", "question": "q", "firstAnswer": "a", "secondAnswer": "b", "vote": "1", "user": {"value": "u"}}\n{"r2": {"prompt": "p", "vote": 12, "user": "x"}}\n{"question": "no id", "x": 1}\n')
    votes = {r["id"]: (r["question"], r["vote"], r["rater"]) for r in readers.votes(spark, str(flat), keyed=False).collect()}
    assert votes == {"r1": ("q", "1", "u"), "r2": ("p", "12", None)}
    (tmp_path / "k.json").write_text('{\n"r3": {"question": "q", "vote": "2"}\n}')
    assert [r["id"] for r in readers.votes(spark, str(tmp_path / "k.json")).collect()] == ["r3"]
    guides = tmp_path / "g"
    guides.mkdir()
    (guides / "WHO.jsonl").write_text('{"id": "1", "name": "T", "content": {"A": "x", "B": {"C": "y"}}}\n{"title": "U"}\n{"clean_text": "z", "text": "no"}\n')
    (guides / "magic.jsonl").write_text('{"id": "9", "text": "skipped"}\n')
    got = {r["variant"]: (r["full_text"], r["parse_failed"], r["guideline_source"]) for r in readers.guidelines(spark, str(guides)).collect()}
    assert got["empty"] == ("U", True, "who") and got["clean_text"][0] == "z" and got["content_dict"][0] == "T\n\n## A\n\nx\n\n## C\n\ny" and len(got) == 3
    assert [readers.format_of(x) for x in ('{"a": 1}\n{"b": 2}', '{\n"a": 1}', '{"a": 1}', "[1,\n2]")] == ["jsonl", "json", "json", "json"]
    found, wrong = readers.load_all(spark, {("votes", "source"): str(flat), ("curated", "source"): str(tmp_path / "none.jsonl"), ("x", "y"): ""})
    assert list(found) == [("votes", "source")]
    assert readers.load(spark, "ballots", "source", str(flat), {"ballots": "votes"}).count() == 2 and len(wrong) == 2
    assert readers.done_ids(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "1", 0.5, None)], "benchmark string, id string, x double, raw string")
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    sinks.write_jsonl(rows, str(tmp_path / "j"), "append")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_csv(rows.select("id", "x"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).collect()[1]["value"] == "1,0.500000"
    sinks.write_reports(rows, str(tmp_path / "r"))
    assert (tmp_path / "r" / "benchmark=a_b").exists()
    for _ in range(2):
        sinks.write_dataset(rows.drop("raw"), str(tmp_path / "d"), {"step": "x"})
    assert spark.read.parquet(str(tmp_path / "d" / "processing_log")).count() == 2
    assert sinks.markdown(rows.select("id", "x")).endswith("| 1 | 0.5000 |")
    calls = []
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for _ in range(2):
        got = sinks.cached_ngrams(spark, items, str(tmp_path / "n"), "b", 2, lambda rows, n: calls.append(n) or decontam.exploded(rows, "item_id", "text", n, True))
    assert calls == [2] and got.count() == 1


def test_streaming(spark, tmp_path):
    from granary.streaming import tagging

    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "a")], "id string, text string")
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        tagging.start(spark, str(tmp_path / "in"), "id string, text string", str(tmp_path / "out"), str(tmp_path / "at"), lambda x: x.withColumn("tag", F.upper("text"))).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_profiles(spark):
    rows = spark.createDataFrame([(1, "b", "x"), (0, "a", "x"), (2, "c", "y")], "id int, v string, k string")
    assert sorted(r["v"] for r in profile.first_of(rows, "k", "id").collect()) == ["a", "c"]
    keys = spark.createDataFrame([(None, "q", "a", "b"), ("p", "q", "a", "b")], "parent string, q string, f string, s string")
    assert [r[0] for r in keys.select(profile.pair_key("parent", "q", "f", "s")).collect()][1] == "p"
    assert profile.distribution(rows, "k").where("k = 'x'").first()["n"] == 2


def test_reports_loop(spark, tmp_path):
    words = "a b c d e f g h i j k l m n".split()
    train = spark.createDataFrame([(1, " ".join(words)), (2, "p q r s t u v w x y z"), (3, "none at all")], "doc_id long, text string")
    items = spark.createDataFrame([("x/1", 7, " ".join(words)), ("y", 8, "p q r s t u v w x y z"), ("z", 9, "n n n")], "benchmark string, item_id long, text string")
    path = str(tmp_path / "reports")
    first = decontam.reports(train, items.where("benchmark = 'x/1'"), path, "doc_id", "item_id")
    assert [(r["doc_id"], r["benchmark"]) for r in first.collect()] == [(1, "x_1")]
    # the old report is not made again, and still counts
    every = decontam.reports(train.where("doc_id <> 1"), items, path, "doc_id", "item_id")
    assert sorted(r["doc_id"] for r in every.collect()) == [1, 2]
    assert [r["doc_id"] for r in decontam.decontaminated(train, every, "doc_id").collect()] == [3]
    assert [r["doc_id"] for r in decontam.reports(train.where("doc_id <> 1"), items, path, "doc_id", "item_id", overwrite=True).collect()] == [2]


def test_hashed_ngrams(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h i a b c d e f g h i x"), (2, ""), (3, None), (4, "a b c d e f g h")], "doc_id long, text string")
    for tail in (False, True):
        plain = {(r["doc_id"], r["ngram"]) for r in decontam.exploded(rows, "doc_id", "text", 8, tail).collect()}
        assert decontam.indexed(rows, "doc_id", 8, tail).distinct().count() == len(plain)


def test_hashed_ngrams_linear(spark):
    # a long text's tokens are hashed once, not again for each token of each n-gram
    words = [f"w{i}" for i in range(8000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:4000] + ["x"] * 9))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[5000:5012])), (8, " ".join(words[100:109]))], "item_id long, text string")
    began = time.time()
    assert sorted(tuple(r) for r in decontam.candidates(docs, items, "doc_id", "item_id").collect()) == [(1, 7), (1, 8), (2, 8)]
    assert time.time() - began < 20


LONG_TEXT = {
    "contamination_counts": [("s", 1)],
    "decontam_filter": [(2, "r")],
    "decontam_verify": [(1, 7, 1.0)],
    "decontaminate": [(2, "w1 w2", "r")],
    "ngram_semi_prefilter": [(1,)],
    "subword_candidates": [(1, 7)],
}


@pytest.mark.parametrize("name", LONG_TEXT)
def test_long_text(spark, tmp_path, name):
    words = [f"w{i}" for i in range(8000)]
    spark.createDataFrame([(1, " ".join(words), "s"), (2, "w1 w2", "r")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words[5000:5012]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    began = time.time()
    assert [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()] == LONG_TEXT[name]
    assert time.time() - began < 20


def test_subwords(spark):
    import pytest

    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, of = Tokenizer.from_file(path), decontam.subwords(path)
    texts = ["Hello worlds, the answer", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["t"] for r in rows.select("doc_id", of("text").alias("t")).collect()} == {i: library.encode(t or "").ids for i, t in enumerate(texts)}
    items = spark.createDataFrame([(1, "see: HELLO WORLDS, the answers")], "item_id long, text string")
    pairs = decontam.candidates(rows, items, "doc_id", "item_id", 3, of)
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]
    assert decontam.verified(pairs, rows, items, "doc_id", "item_id", 0.1, of).count() <= 1


def test_retries(spark, tmp_path):
    prompts = spark.createDataFrame([("a", 0), ("b", 2), ("c", 9)], "key string, needs int")
    seen = []

    def model(rows, temperature):
        seen.append((round(temperature, 1), rows.count()))
        return rows.select("key", F.when(F.col("needs") <= len(seen) - 1, "good").otherwise("bad").alias("answer"))

    got = generation.retried(prompts, model, lambda a: F.col(a) == "good", str(tmp_path / "t"), retries=3, temperature=0.6)
    assert sorted(map(tuple, got.collect())) == [("a", "good", 0), ("b", "good", 2), ("c", "bad", 3)]
    assert seen == [(0.6, 3), (0.8, 2), (1.0, 2), (1.0, 1)]


def test_judging_tables(spark):
    scores = "\n".join(f"{c}: {n}" for c in judge.CRITERIA for n in (4, 2))
    items = spark.createDataFrame([("p", True, "1"), ("q", False, "2"), ("r", False, "1")], "key string, swap boolean, vote string")
    replies = spark.createDataFrame([("p", f"{scores}\nReasoning: x\nWinner: Model 1"), ("q", f"{scores}\nWinner: Tie"), ("r", "nothing")], "key string, reply string")
    judged = judge.judge_rows(items, replies, "key", "reply", "swap")
    got = {r["key"]: (r["judge_vote"], (r["first"] or {}).get("Fairness"), (r["second"] or {}).get("Fairness")) for r in judged.collect()}
    assert got == {"p": ("2", 2, 4), "q": ("12", 4, 2), "r": (None, None, None)}
    of = lambda n: F.create_map(F.lit("Fairness"), F.lit(n))
    margins = judge.chosen_margins(items.withColumns({"first": of("5"), "second": of("3")}), judged, "key").where("criterion = 'Fairness'").first()
    # p: the first answer was chosen, 2 - 4 for the judge; q: the second, 2 - 4
    assert (margins["judge_diff"], margins["judge_n"], margins["human_diff"], margins["human_n"]) == (-2.0, 2, 0.0, 2)
    votes = spark.createDataFrame([("p", "1"), ("p", "1"), ("q", "2"), ("q", "12"), ("r", "1")], "key string, vote string")
    panel = judge.judge_against_panel(votes, judged, "key", "vote", "judge_vote").first()
    assert panel["n"] == 2 and panel["agreement"] == 0.5
    one_rater = judge.kappa_summary(spark.createDataFrame([(0.4,)], "kappa double"), 0.5).first()
    assert one_rater["std"] == 0.0 and one_rater["z"] is None and one_rater["share_below"] == 1.0
    assert "Model 2:\na" in one(spark, judge.shown("q", "a", "b", "s"), q="q", a="a", b="b", s=True)


def test_grades(spark):
    replies = ['```json\n{"criteria_met": true, "explanation": "x"}\n```', '{"criteria_met": "true"}', '{"criteria_met": false}', "no", "{}", None]
    assert many(spark, text.criteria_met, replies) == [True, None, False, None, None, None]
    examples = spark.createDataFrame([("e", [("user", "hi")], [("c1", 5.0, ["t"]), ("c2", -2.0, [])], ["x"])], "prompt_id string, prompt array<struct<role: string, content: string>>, rubrics array<struct<criterion: string, points: double, tags: array<string>>>, example_tags array<string>")
    items = rubric.items(examples)
    graded = rubric.resolved(rubric.grades(items, spark.createDataFrame([("e", 0, replies[0])], "prompt_id string, rubric int, reply string"), ["prompt_id", "rubric"]))
    assert sorted((r["rubric"], r["met"]) for r in graded.collect()) == [(0, True), (1, False)]
    asked = items.join(examples.select("prompt_id", "prompt"), "prompt_id").where("rubric = 0").select(rubric.grader_prompt("<<conversation>> / <<rubric_item>>").alias("x")).first()["x"]
    assert asked == "user: hi / [5.0] c1"
    assert one(spark, rubric.unmet_first(F.array(F.struct(F.lit(True), F.lit(0)), F.struct(F.lit(False), F.lit(1)))), v=1)[0][1] == 1
    assert one(spark, rubric.length_adjusted("s", "n", 500, 0.1), s=0.5, n=1000) == 0.4
    scored = spark.createDataFrame([("a", i / 100) for i in range(100)] + [("b", 0.5)] * 30, "tag string, score double")
    got = {r["tag"]: r["bootstrap_std"] for r in rubric.bootstrap_deviation(scored, "tag", chunk=16).collect()}
    assert 0.022 < got["a"] < 0.036 and got["b"] < 1e-9
    assert 0.02 < rubric.bootstrap_deviation(scored.where("tag = 'a'")).first()["bootstrap_std"] < 0.04


def test_prompts(spark, tmp_path):
    pool = spark.createDataFrame([(f"q{i}", f"a{i}") for i in range(9)], "question string, answer string")
    shots = sampling.draws(pool, 1.4, "question")
    assert shots.groupBy("draw").agg(F.countDistinct("example").alias("n")).where("n = 5").count() == 12
    for variant, tag in (("labelled", "<answer>"), ("open", "<answer>"), ("question", "</question>")):
        prompt = conversations.few_shot_prompt(shots, "draw", variant).first()["prompt"]
        assert prompt.count("--- Example ") == 5 and tag in prompt and prompt.endswith(conversations.REQUESTS[variant])
    asked = one(spark, conversations.guideline_prompt("v"), v="G")
    assert "G" in asked and "10 multiple-choice" in asked and "<qa>" in asked
    messages = spark.createDataFrame([([("user", 'a "b"\n/é\\'), ("x", "")],)], "m array<struct<role: string, content: string>>")
    want = json.dumps([{"role": "user", "content": 'a "b"\n/é\\'}, {"role": "x", "content": ""}], sort_keys=True, ensure_ascii=False)
    assert messages.select(generation.messages_json("m")).first()[0] == want
    row = spark.createDataFrame([("q", "a", "B")], "q string, a string, l string").select(conversations.synthetic_row("q", "a", "l").alias("r")).first()["r"]
    assert row["is_labeled"] and [t["from"] for t in row["conversations"]] == ["human", "assistant"]
    rows = spark.createDataFrame([([("system", "s"), ("gpt", "x"), (None, "y")], None)], "conversations array<struct<from: string, value: string>>, exact_match boolean")
    ready = conversations.prepared(rows).first()
    assert (len(ready["conversations"]), ready["exact_match"], ready["try_count"]) == (2, False, 0)
    assert [x["role"] for x in conversations.prepared(rows).select(conversations.with_roles("conversations").alias("r")).first()["r"]] == ["assistant", None]
    counts = generation.pattern_counts(spark.createDataFrame([(True, "mmlu_pro"), (True, None), (False, "mmlu_pro")], "match boolean, pattern string"))
    assert {r["pattern"]: r["n"] for r in counts.collect()} == {"mmlu_pro": 1, "none": 1}
    assert one(spark, generation.completion_id("a", "b"), a="x", b="y") == one(spark, F.sha2(F.lit("xy"), 256), v=1)
    retries = spark.createDataFrame([(None, None), ("B", False), ("B", True), ("", False)], "l string, m boolean")
    again = [[r[0] for r in retries.select(generation.to_retry(a, resumed, "l", "m")).collect()] for a, resumed in ((1, False), (1, True), (2, False))]
    assert again == [[True] * 4, [False, True, False, False], [False, True, False, False]]


def test_samples(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}") for i in range(100)], "id int, g string")
    got = sampling.numbered(rows, "id", parts=7)
    assert sorted(r["number"] for r in got.collect()) == list(range(100))
    assert {r["id"] for r in sampling.problem_samples(rows, "g", "id", 2, "id").collect()} == {0, 1, 2, 3, 4, 5}
    sample = sampling.eval_sample(rows, 10, 3, "id")
    assert sample.count() == 30 and sample.select("id").distinct().count() == 10 and sampling.eval_sample(rows, None, 2, "id").count() == 200
    kinds = spark.createDataFrame([("votes", "source", "1", False, None, False), ("guides", "source", None, True, "who", False), ("curated", "synthetic", None, False, None, True), ("curated", "source", None, False, None, True)], "pair string, split string, vote string, is_document boolean, guideline_source string, is_mcq boolean")
    assert [r[0] for r in kinds.select(sampling.stratum_of()).collect()] == ["1", "who", "true", None]
    shares = spark.createDataFrame([(f"c{i:02}", i / 1000, 0.0) for i in range(20)], "category string, prop_source double, prop_synthetic double")
    shown = profile.shown_categories(shares)
    assert shown.count() == 15 and profile.by_source_share(shown).first()["category"] == "c19" and profile.shown_categories(shares.limit(12)).count() == 12
    fields = spark.createDataFrame([("b",), ("z",), ("a",)], "field string")
    assert [r[0] for r in profile.in_field_order(fields, ["b", "a"]).collect()] == ["b", "a", "z"]
    pairs = spark.createDataFrame([("q", "a", "B"), ("q", "a", None), (None, "a", "B")], "question string, answer string, label_letter string")
    assert [x.count() for x in profile.routed(pairs)] == [1, 1]
    import pytest

    with pytest.raises(ValueError):
        profile.routed(pairs.where("label_letter is null"))
    voted = spark.createDataFrame([("1", "a", "b"), ("3", "a", "b"), ("2", "", "b")], "vote string, first_answer string, second_answer string")
    assert voted.where(profile.is_voted()).count() == 1
    assert many(spark, text.short_count, [999, 12345, 1234567], "long") == ["999", "12.3k", "1.2M"]
    assert one(spark, text.pretty("v"), v="life_threatening") == "Life Threatening" and one(spark, text.file_name("v"), v="a/b: c") == "a_b__c"
    assert math.isclose(one(spark, text.retry_temperature(0.7, "v"), v=1), 0.9) and one(spark, text.final_channel("v"), v="a<|channel|>final<|message|>b<|channel|>final<|message|>c") == "c"
    assert one(spark, text.tagged("v", "question"), v="x <Question> a </question>") == "a" and one(spark, judge.is_valid("v"), v="winner: tie")
    assert tuple(one(spark, judge.chosen("v", "a", "b"), v="2", a="x", b="y")) == ("y", "x")
    # the same area whether the ranges are many or one
    values = spark.createDataFrame([("a", float(i * i % 37)) for i in range(300)] + [("b", float(i % 23)) for i in range(200)], "arm string, v double")
    import itertools

    cdf = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    a, b = [float(i * i % 37) for i in range(300)], [float(i % 23) for i in range(200)]
    points = sorted({*a, *b})
    assert math.isclose(divergence.wasserstein(values, "arm", "v", "a", "b").first()[0], sum(abs(cdf(a, x) - cdf(b, x)) * (y - x) for x, y in itertools.pairwise(points)))


def test_more_sources(spark, tmp_path):
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"question": " a "}\n{"question": 5}\n{bad\n\n{"question": "  "}\n{"x": 1}\n{"question": "b"}\n')
    assert sorted(r[0] for r in readers.questions(spark, str(lines)).collect()) == ["a", "b"]
    hard = tmp_path / "hard.jsonl"
    hard.write_text('{"prompt_id": "1", "prompt": [{"role": "user", "content": "x"}], "rubrics": [{"criterion": "c", "points": 3, "tags": ["t"]}], "example_tags": []}\n')
    assert readers.rubric_examples(spark, {"hard": str(hard)}, "hard").first()["rubrics"][0]["points"] == 3.0
    bench = readers.benchmarks(spark, {"m": (str(lines.with_name("b.jsonl")), "options")} if lines.with_name("b.jsonl").write_text('{"question": "s", "opa": "1", "opb": "2", "opc": "3", "opd": "4"}\n') else {}, "question string, opa string, opb string, opc string, opd string")
    assert [tuple(r) for r in bench.collect()] == [("m", 0, "s\n1\n2\n3\n4")]
    for name in ("a", "b"):
        spark.createDataFrame([(name,)], "x string").write.parquet(str(tmp_path / name))
    both = readers.splits(spark, {"train": str(tmp_path / "a"), "test": str(tmp_path / "b")})
    assert sorted(map(tuple, both.collect())) == [("a", "train"), ("b", "test")]
    import pytest

    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{bad\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    assert [r[0] for r in readers.done_ids(spark, str(tmp_path / "bad.jsonl")).collect()] == ["1"]
    (tmp_path / "c.yaml").write_text("paths:\n  one: data/x\n  two: /abs/y\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        assert readers.config(None, {"one": "z"}, "/r") == {"one": "/r/z"}
    else:
        assert readers.config(str(tmp_path / "c.yaml"), {"two": None, "three": "z"}, "/r") == {"one": "/r/data/x", "two": "/abs/y", "three": "/r/z"}
    formats = spark.createDataFrame([("s", ["c1", "c2"], "Q")], "question string, CONTEXTS array<string>, QUESTION_ string").withColumnRenamed("QUESTION_", "Q2")
    assert formats.select(decontam.PROMPTS["question"]()).first()[0] == "s"
    talk = spark.createDataFrame([([("user", "u"), ("human", "h")],)], "conversations array<struct<from: string, value: string>>")
    assert [talk.select(decontam.PROMPTS["sharegpt"](*x)).first()[0] for x in ((), (("user", "human"),))] == ["h", "u"]


def test_more_sinks(spark, tmp_path):
    line = spark.createDataFrame([("m", 0.5, None)], "model string, x double, y double")
    for _ in range(2):
        sinks.write_csv(line.coalesce(1), str(tmp_path / "s"), mode="append")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "s")).collect()) == ["m,0.500000,", "m,0.500000,", "model,x,y"]
    found = spark.createDataFrame([("p", "b", "jensen_shannon", 0.2, 0.1, 0.3), ("p", "a", "wasserstein_1", 1.5, 1.0, 2.0), ("p", "c", "total_variation", 0.1, 0.0, 0.2)], "pair string, field string, metric string, value double, ci_low double, ci_high double")
    report = sinks.divergence_report(found, line, ["b", "a"])
    assert "## P" in report and "| b | JSD | 0.200 | [0.100, 0.300] | moderate shift |\n| a | Wasserstein-1 | 1.500" in report and "## Task format" in report and "| c |" not in report
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n int")
    assert sorted(map(tuple, sinks.with_missing(counts, spark.createDataFrame([("a", 7)], "g string, n int"), "g").collect())) == [("a", 7), ("b", 2)]
    sinks.append_answers(spark.createDataFrame([("k", "x")], "key string, answer string"), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).columns == ["key", "answer", "at"]
    records = spark.createDataFrame([("d", True, None, None, "y" * 7000), ("q", False, "Q", "A", "")], "id string, is_document boolean, question string, answer string, full_text string")
    from granary.operators import metadata

    prompts = {r["id"]: r["messages"] for r in metadata.tag_prompts(records, "sys q", "sys d").collect()}
    assert prompts["d"][0]["content"] == "sys d" and conversations.MARK in prompts["d"][1]["content"] and "ANSWER:\nA" in prompts["q"][1]["content"]
    tagged = metadata.tagged(records.withColumn("raw", F.lit("x")), spark.createDataFrame([("q", '{"specialty": "cardiology"}')], "id string, reply string"))
    assert "raw" not in tagged.columns and tagged.where(metadata.usable("specialty")).count() == 1 and metadata.parse_rate(tagged).first()["n_ok"] == 1
    assert conversations.union_all(records.select("id"), records.select("id", "answer")).count() == 4
