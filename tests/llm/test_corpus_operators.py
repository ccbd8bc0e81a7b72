"""Joins, mixtures and the pipeline against brute force."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, same
from tests.llm.test_text_operators import ODD, WORD, documents, none, odd, plain_hits  # noqa: F401

import corpus_pipeline
from granary.llm import common, graph, jaccard, mixing, toxicity


def shingles(text, k):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(mixing_upper(), mixing_upper().lower())))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def mixing_upper():
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_join(rows, k, t):
    sets = [(i, shingles(text, k)) for i, text in rows]
    pairs = []
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b:
                n = len(a & b)
                if n * t.denominator >= (len(a) + len(b) - n) * t.numerator:
                    pairs.append((i, j))
    found = roots([i for i, _ in sets], pairs)
    return {i: (len(a), found[i]) for i, a in sets}


def near_copies(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[pick.choice(vocabulary) for _ in range(pick.choice([3, 4, 6, 30, 80, 200]))] for _ in range(12)]
    shared = [pick.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(n):
        words = list(pick.choice(bases))
        for _ in range(pick.choice([0, 0, 1, 2, 3, 8])):
            words[pick.randrange(len(words))] = pick.choice(vocabulary)
        if pick.random() < 0.2:
            words = words[: pick.randrange(1, len(words) + 1)]
        if pick.random() < 0.2:
            words += shared
        out.append(" ".join(w.upper() if pick.random() < 0.1 else w for w in words))
    return out


@pytest.mark.parametrize(("k", "t"), [(4, Fraction(85, 100)), (5, Fraction(8, 10)), (2, Fraction(1, 2)), (3, Fraction(1))])
def test_jaccard(spark, k, t):
    rows = list(enumerate(near_copies(k, 400) + ["", None, " ", "a", "A"]))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit(0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, k, t).collect()}
    assert got == plain_join(rows, k, t)


def slotted(n, values=50, length=100):
    """Pages of one template that differ in three slots: two slots in common link, one doesn't."""
    pick = random.Random(n)
    frame = [f"t{i}" for i in range(length)]
    out = []
    for _ in range(n):
        words = list(frame)
        for at in (length // 5, length // 2, length * 4 // 5):
            words[at] = f"s{at}v{pick.randrange(values)}"
        out.append(" ".join(words))
    return out


def test_template_pages(spark, monkeypatch):
    # the groups opened must not grow faster than the pages
    opened, real = {}, jaccard.opened_groups
    for n in (800, 1600, 3200):

        def counted(cells, t, n=n):
            found = real(cells, t)
            opened[n] = found.count()
            return found

        monkeypatch.setattr(jaccard, "opened_groups", counted)
        rows = list(enumerate(slotted(n)))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, Fraction(85, 100)).collect()}
        slots = [(i, tuple(x.split()[at] for at in (20, 50, 80))) for i, x in rows]
        by_two = {}
        for i, s in slots:
            for gone in range(3):
                by_two.setdefault((gone, s[:gone] + s[gone + 1 :]), []).append(i)
        assert got == {i: (97, r) for i, r in roots(range(n), [(x[0], y) for x in by_two.values() for y in x[1:]]).items()}
    # no more than HOT groups for each shingle of a prefix, however many pages there are, and no faster growth than the pages'
    assert all(opened[n] <= jaccard.HOT * n for n in opened) and opened[1600] <= 2 * opened[800] and opened[3200] <= 4 * opened[800], opened


@pytest.mark.parametrize(("k", "t"), [(4, Fraction(85, 100)), (2, Fraction(3, 5))])
def test_jaccard_hot(spark, monkeypatch, k, t):
    # nearly every list is taken apart: templates of words in common, of several lengths and similarities
    monkeypatch.setattr(jaccard, "HOT", 1)
    monkeypatch.setattr(jaccard, "HEAVY_FROM", 64)
    pick = random.Random(k)
    texts = near_copies(7, 150) + slotted(120, 4, 60) + slotted(60, 3, 90)
    for _ in range(120):
        words = [f"u{i}" for i in range(40)]
        for _ in range(pick.choice([1, 2, 3])):
            words[pick.randrange(40)] = f"v{pick.randrange(3)}"
        texts.append(" ".join(words[: pick.choice([40, 40, 38, 36])]))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, k, t).collect()}
    assert got == plain_join(rows, k, t)


@pytest.mark.parametrize("heavy", [1 << 16, 40])
def test_template_shingles_make_no_rows(spark, monkeypatch, heavy):
    # copies share most shingles: a node gets rows for what it alone has and for its places in lists, none for each shingle of the template
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    made, real, t = {}, jaccard.stored, Fraction(8, 10)
    for n in (200, 400):
        pick, rows = random.Random(n), []
        for i in range(n):
            words = [f"t{x}" for x in range(120)]
            edits = range(at := pick.randrange(117), at + (i // 40 % 2 + 2 if i % 40 == 0 else 1)) if i % 4 < 3 else pick.sample(range(120), 4)
            for x in edits:
                words[x] = f"own{i}x{x}"
            rows.append((i, " ".join(words), len(edits) == 1))
        sets = [set(zip(*(x.split()[j:] for j in range(5)))) for _, x, _ in rows]

        def counted(df, what, n=n):
            out = real(df, what)
            if what in ("parts", "placed", "below"):
                made[n] = made.get(n, 0) + out.count()
            return out

        monkeypatch.setattr(jaccard, "stored", counted)
        docs = spark.createDataFrame([(i, x, len(s), alike) for (i, x, alike), s in zip(rows, sets)], "doc_id long, text string, n long, alike boolean")
        nodes = jaccard.with_nodes(docs, 5).select(F.col("_node").alias("node"), "doc_id", "n", F.when(F.col("alike"), F.lit(0)).otherwise(F.col("_node")).alias("root"))
        at = {}
        for r in jaccard.narrowed(docs, nodes, 5, jaccard.Threshold(t)).join(nodes.select("node", "doc_id"), "node").collect():
            at.setdefault(r["doc_id"], set()).add(r["token"])
        links = [(i, j) for i in range(n) for j in range(i) if not (rows[i][2] and rows[j][2]) and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]
        assert len(links) > 100 and all(at[i] & at[j] for i, j in links)
    if heavy > 40:
        assert all(made[n] <= 50 * n for n in made) and made[400] <= 2.2 * made[200], made


def test_jaccard_hot_halves(spark, monkeypatch):
    # lists that are taken apart more than once, with shingles on both sides of the most frequent ones
    monkeypatch.setattr(jaccard, "HOT", 1)
    monkeypatch.setattr(jaccard, "HEAVY", 25)
    rows = list(enumerate(near_copies(7, 100) + slotted(120, 4, 60) + slotted(60, 3, 90)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, Fraction(85, 100)).collect()}
    assert got == plain_join(rows, 4, Fraction(85, 100))


def test_jaccard_odd(spark, odd, none):  # noqa: F811
    got = jaccard.jaccard_join(odd, 4, Fraction(85, 100)).collect()
    assert len(got) == len(ODD) + 2
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted([(i, i) for i in range(len(ODD))] + [(0, 0)])
    assert jaccard.jaccard_join(none, 4, Fraction(85, 100)).count() == 0
    repeated = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (1, "other words here now"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in jaccard.jaccard_join(repeated, 4, Fraction(85, 100)).collect()))) == sorted(map(str, [(1, 3, 1), (1, 3, 1), (2, 3, 1), (1, 1, 1), (None, 3, 1)]))
    assert sorted((r["doc_id"] or 0, r["text"][:1]) for r in jaccard.one_of_each(repeated, 4, Fraction(85, 100)).collect()) == [(0, "a"), (1, "a"), (1, "o")]


def test_one_of_each_namesakes(spark):
    x, y, z = ("".join(f"{c}{i} " for i in range(40)) for c in "xyz")
    near, other = x + "more", y + "more"
    rows = [(1, x), (2, x), (2, y), (2, ""), (3, z), (3, z + "more"), (3, z.upper()), (4, other), (5, near), (5, None), (6, "a b c d e f g"), (None, x)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    got = jaccard.one_of_each(docs, 5, Fraction(8, 10))
    assert got.columns == docs.columns
    kept = [rows[r["n"]] for r in got.collect()]
    # of each group of x, y and z one row with words, besides rows without doc_id
    for c, i in (("x", 1), ("y", 2), ("z", 3)):
        assert [k for k, t in kept if k is not None and (t or "").lower().startswith(c)] == [i], kept
    assert sorted(i or 0 for i, t in kept if not (t or "").lower().startswith(("x", "y", "z"))) == [2, 5, 6] and (None, x) in kept


def test_jaccard_sql(spark, duck):
    from granary.llm import queries

    same(jaccard.op6_jaccard_join(spark, SF), duck.sql(queries.SQL["op6_jaccard_join"]).df())


def test_sketch():
    import numpy as np

    pick = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 200):
        a = np.unique(pick.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2 + 1], pick.integers(0, 2**63, n // 2, dtype=np.uint64)]))
        x, y = sorted((jaccard.sketch(a), jaccard.sketch(b)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


def test_components(spark):
    pick = random.Random(3)
    pairs = [(pick.randrange(300), pick.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: r for n, r in want.items() if n in touched}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    low, high = 0.0, 1e12  # water level: words for each unit of weight
    total = min(1.5 * sum(n for _, n in sizes), 2 * sum(n for _, n in sizes))
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * n, mid * weight[s]) for s, n in sizes) < total else (low, mid)
    return {s: min(2 * n, high * weight[s]) for s, n in sizes}


def test_targets():
    pick = random.Random(4)
    for _ in range(50):
        sizes = [(None if i == 3 else f"s{i}", pick.choice([0, 1, 10, 1000, 50_000])) for i in range(pick.randint(1, 9))]
        got, want = mixing.targets(sizes), plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-4 * max(1, want[s]) for s in want), sizes


@pytest.mark.parametrize("bucket", [mixing.BUCKET, 3])
def test_mix(spark, odd, none, monkeypatch, bucket):  # noqa: F811
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    docs = documents(spark).select("doc_id", "text", "source", F.lit(1).alias("size")).unionAll(odd.select("doc_id", "text", "source", F.lit(1).alias("size")))
    rows = mixing.mix(docs).collect()
    given = docs.collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r["doc_id"] or -1, len([w for w in (r["text"] or "").replace("\n", " ").split(" ") if w])) for r in given)
    sums = {}
    for r in given:
        n = len([w for w in (r["text"] or "").replace("\n", " ").split(" ") if w])
        sums[r["source"]] = sums.get(r["source"], 0) + n
    want = plain_targets(list(sums.items()))
    assert sorted({(r["source_size"], round(r["target"], 2)) for r in rows}) == sorted({(sums[s], round(want[s], 2)) for s in sums})
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by_source = {}
    for r in rows:
        key = (r["source_size"], r["target"])
        by_source[key] = by_source.get(key, 0) + r["taken"]
    assert all(abs(taken - target) <= 0.02 * target + 20 for (_, target), taken in by_source.items())
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0


def test_schedule(spark):
    docs = documents(spark)
    placed, sources, schedule = mixing.plan(docs)
    slots = schedule.orderBy("slot").collect()
    share = {r["_lane"]: r["target"] for r in sources.collect()}
    total, seen = sum(share.values()), {}
    for i, r in enumerate(slots, 1):
        assert seen.get((r["_lane"], "n"), 0) % {s["_lane"]: s["blocks"] for s in sources.collect()}[r["_lane"]] == r["block"] if i <= 30 else True
        seen[(r["_lane"], "n")] = seen.get((r["_lane"], "n"), 0) + 1
        if i in (100, 1000, len(slots)):
            assert all(abs(seen.get((lane, "n"), 0) - i * t / total) < 6 for lane, t in share.items())


def test_mix_small_sources(spark, monkeypatch):
    # blocks of 1,219 words of the large source
    monkeypatch.setattr(mixing, "SLOTS", 64)
    sizes = {"a": 50_000, "b": 1_990, "c": 37, "d": 1, None: 3}
    rows = [(i, " ".join(["w"] * len(range(at, min(at + 97, n)))), s) for s, n in sizes.items() for i, at in enumerate(range(0, n, 97))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = plain_targets(list(sizes.items())), {}
    for r in mixing.mix(docs).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source_size"]] = got.get(r["source_size"], 0) + r["taken"]
    assert all(abs(got[n] - want[s]) <= 0.5 for s, n in sizes.items()), (got, want)
    _, sources, schedule = mixing.plan(docs)
    slots = schedule.orderBy("slot").collect()
    lane = {r["source"]: r["_lane"] for r in sources.collect()}["b"]
    first = [r["words"] for r in slots[: len(slots) // 2] if r["_lane"] == lane]
    assert abs(sum(first) - want["b"] / 2) < 0.05 * want["b"]


def test_pipeline(spark):
    docs = documents(spark)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    kept = corpus_pipeline.stored(stages["near_duplicates"](spark, docs, SF), "test")
    want = plain_join([(r["doc_id"], r["text"]) for r in docs.collect()], 5, Fraction(8, 10))
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, root) in want.items() if i == root}
    left = stages["decontamination"](spark, docs, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs.collect()
    hits = plain_hits([r["text"] for r in rows], items, 10)
    assert left.columns == columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r, h in zip(rows, hits, strict=True) if not h[1]}
    masked = stages["secrets"](spark, docs, SF)
    assert masked.columns == columns and masked.count() == docs.count()
    assert jaccard and corpus_pipeline.run(spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_pipeline_odd(spark, odd, none):  # noqa: F811
    extra = odd.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (extra, extra.limit(0)):
            got = stage(spark, docs, SF)
            got.count()
            assert name == "mixing" or got.columns == docs.columns


def test_mixing_needs_no_python_workers(spark):
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_small_batches(spark, name, stage):
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    try:
        spark.conf.set(option, "10000")
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        assert int(spark.conf.get(option)) == corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(option, before)


def test_power_tables_follow_the_step(monkeypatch):
    monkeypatch.setattr(common, "_powers", [])
    few, many = [b"a b c d e"], [b"x y z " * 30_000, b"a b c d e"]
    first = common.shingle_sets(few, 4)[0]
    assert sum(x.nbytes for x in common._powers) <= 1 << 20
    assert common.shingle_sets(many, 4)[1].tolist() == first.tolist() == common.shingle_sets(few, 4)[0].tolist()


def test_feature_counts_of_small_batches(spark, monkeypatch):
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    rows = spark.createDataFrame([(i % 2, f"word{'abcdefghij'[i % 10]} same") for i in range(200)], "label int, text string").coalesce(1)
    plain = {}
    for label, text in rows.collect():
        for x in toxicity.features_in(text):
            n, a = plain.get(x, (0, 0))
            plain[x] = n + 1, a + label
    try:
        spark.conf.set(option, "7")
        got = toxicity.feature_counts(rows)
        assert {r["feature"]: (r["n"], r["a"]) for r in got.collect()} == plain
        monkeypatch.setattr(toxicity, "COUNTED", 1)  # every batch is sent on by itself
        assert {r["feature"]: (r["n"], r["a"]) for r in toxicity.feature_counts(rows).collect()} == plain
    finally:
        spark.conf.set(option, before)
