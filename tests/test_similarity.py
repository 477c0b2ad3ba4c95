import math
from collections import Counter

import pytest
from pyspark.sql import functions as F


def test_tf_cosine_matches_brute_force(spark):
    from patchlens.operators.similarity import LEXICAL_MODELS, score_lexical
    texts = [("1", "the cat sat on the mat", "the cat sat"), ("2", "a b c", "d e f"), ("3", "", "x y"),
             ("4", "Ünd ünd über", "ÜND über über"), ("5", "same text here", "  SAME text here\n")]
    df = spark.createDataFrame(texts, "pair_id string, summary string, explanation string")
    got = {(r.pair_id, r.model): r.score for r in score_lexical(df).collect()}

    def cos(a, b):
        ca, cb = Counter(a), Counter(b)
        dot = sum(ca[t] * cb[t] for t in ca)
        na, nb = math.sqrt(sum(v * v for v in ca.values())), math.sqrt(sum(v * v for v in cb.values()))
        return dot / (na * nb) if na and nb else None

    import re
    def words(s):
        return [w for w in re.split(r"[^\w]+", s.strip().lower()) if w]

    for pid, a, b in texts:
        wa, wb = words(a), words(b)
        exp = {"word_tf": cos(wa, wb),
               "word_bigram_tf": cos([f"{x} {y}" for x, y in zip(wa, wa[1:])], [f"{x} {y}" for x, y in zip(wb, wb[1:])]),
               "char3_tf": cos([a.strip().lower()[i:i + 3] for i in range(len(a.strip()) - 2)],
                               [b.strip().lower()[i:i + 3] for i in range(len(b.strip()) - 2)])}
        for m in LEXICAL_MODELS:
            if exp[m] is None:
                assert got[(pid, m)] is None
            else:
                assert abs(got[(pid, m)] - exp[m]) < 1e-12, (pid, m)


def test_verdict_uses_unrounded_score(spark):
    from patchlens.operators.similarity import verdict
    df = spark.createDataFrame([(0.597,), (0.6,), (None,)], "s double")
    got = df.select(*verdict(F.col("s"))).collect()
    assert [(r.shown, r.is_match) for r in got] == [("0.60", False), ("0.60", True), (None, False)]


def test_shown_scores_equal_python(spark):
    import random
    rng = random.Random(8)
    values = [0.595, 0.125, 0.375, 0.005, 0.015, 0.995, 1.0, 0.0, -0.0, -0.001, -0.125, 0.6, 1e-300, 5e-324, 2.675, 1e6 + 0.125, 12345678.905, 2.0 ** 43 + 0.5, 1e18]
    values += [rng.uniform(-1, 1) for _ in range(10_000)] + [rng.randrange(-10**6, 10**6) / 1000 for _ in range(2000)] + [
        rng.randrange(-4000, 4000) / 800 for _ in range(2000)] + [rng.uniform(-1e12, 1e12) for _ in range(1000)]
    from patchlens.operators.similarity import two_places
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", two_places(F.col("v")).alias("t")).collect()
    assert [v for i, v in ((r.i, values[r.i]) for r in got if r.t != f"{values[r.i]:.2f}")] == []


def test_stored_texts_are_scored_without_an_exchange(spark, tmp_path):
    from patchlens.operators.similarity import score_pairs, score_stored, store_texts
    s = spark.createDataFrame([(str(i), f"word{i % 7} of text {i}") for i in range(200)] + [(None, "x")], "pair_id string, summary string")
    e = spark.createDataFrame([(str(i), f"word{i % 5} of text {i}") for i in range(0, 300, 3)] + [("5", None)], "pair_id string, explanation string")
    for name, df in (("stored_s", s), ("stored_e", e)):
        for _ in range(2):  # writing again replaces
            store_texts(df, name, str(tmp_path / name), buckets=4)
    try:
        stored = score_stored(spark, "stored_s", "stored_e")
        key = lambda r: (r.pair_id, r.model, r.score, r.shown, r.is_match, r.error)
        assert sorted(map(key, stored.collect()), key=str) == sorted(map(key, score_pairs(s, e).collect()), key=str)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert len(list((tmp_path / "stored_s").glob("*.parquet"))) == 4
    finally:
        for name in ("stored_s", "stored_e"):
            spark.sql(f"DROP TABLE {name}")


def test_dense_cosine_and_slices(spark):
    from patchlens.operators.similarity import score_dense
    df = spark.createDataFrame([("p", [1.0, 0.0, 1.0, 1.0], [1.0, 0.0, 0.0, 1.0]), ("z", [0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0])],
                               "pair_id string, a array<float>, b array<float>")
    got = {(r.pair_id, r.model): r.score for r in score_dense(df, "pair_id", "a", "b", [("all", 1, 4), ("head", 1, 2)]).collect()}
    assert abs(got[("p", "all")] - 2 / math.sqrt(6)) < 1e-12
    assert got[("p", "head")] == 1.0
    assert got[("z", "all")] is None


def test_missing_scores_say_why(spark):
    from patchlens.operators.similarity import score_dense, score_lexical
    df = spark.createDataFrame([("none", [1.0], None), ("short", [1.0, 2.0], [1.0]), ("zero", [0.0, 0.0], [1.0, 1.0]), ("ok", [1.0], [2.0])],
                               "pair_id string, a array<float>, b array<float>")
    got = {r.pair_id: (r.error, r.is_match) for r in score_dense(df, "pair_id", "a", "b").collect()}
    assert got == {"none": ("missing_vector", False), "short": ("unequal_length", False), "zero": ("zero_norm", False), "ok": (None, True)}
    texts = spark.createDataFrame([("1", "a", None), ("2", "a b", "a b")], "pair_id string, summary string, explanation string")
    got = {(r.pair_id, r.model): r.error for r in score_lexical(texts).collect()}
    assert got[("1", "word_tf")] == "empty_text" and got[("2", "word_tf")] is None and len(got) == 6


def test_score_pairs_end_to_end(spark):
    from patchlens.plans.analyze import run_items
    buggy = spark.createDataFrame([("1", "def f():\n    return 1\n"), ("2", "def g():\n    x = 1\n")],
                                  "pair_id string, source string")
    replies = spark.createDataFrame([("1", "```python\ndef f():\n    return 2\n```\n---EXPLANATION---\nChange of type return change"),
                                     ("2", "NO BUGS FOUND")], "pair_id string, reply string")
    out = run_items(buggy, replies)
    s = {(r.pair_id, r.model): r for r in out["scores"].collect()}
    assert s[("1", "word_tf")].score > 0.3
    assert s[("2", "word_tf")].score is None and s[("2", "word_tf")].is_match is False
    assert {r.pair_id: r.status for r in out["items"].collect()} == {"1": "ok", "2": "no_bug"}


def test_run_items_reports_parse_errors_once(spark):
    from patchlens.plans.analyze import run_items
    items = spark.createDataFrame([
        ("ok", "def f():\n    return 1\n", "def f():\n    return 2\n---EXPLANATION---\nx"),
        ("bad", "def f(:\n", "def f():\n    pass\n---EXPLANATION---\ny"),
        ("nod", "def f():\n    pass\n", "no delimiter here")], "pair_id string, source string, reply string")
    out = run_items(items)
    st = {r.pair_id: (r.status, r.error is not None) for r in out["items"].collect()}
    assert st == {"ok": ("ok", False), "bad": ("parse_error", True), "nod": ("no_delimiter", False)}
    scores = {r.pair_id: r for r in out["scores"].where("model = 'word_tf'").collect()}
    assert set(scores) == {"ok", "bad"} and scores["bad"].score is None and scores["bad"].error.startswith("SyntaxError")
    assert {r.rule for r in out["changes"].collect()} == {"R17", "R30"}
    for frame in ("items", "scores"):
        plan = out[frame]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("MapInArrow") == 1 and "RoundRobin" not in plan
    assert "SortAggregate" not in out["items"]._jdf.queryExecution().executedPlan().toString()


def test_planning_runs_no_job(spark):
    from patchlens.plans.flagship import flagship
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        frame = flagship(spark, "/root/testdata/sf0.001")
        jobs = tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 1  # the schema of the parquet file
    rows = frame.where("model = 'word_tf'").select("is_match", "error").distinct().collect()
    assert {r.is_match for r in rows} == {True, False}


@pytest.mark.parametrize("name", ["score_lexical", "score_pairs", "end_to_end"])
def test_terms_are_counted_by_hash_aggregation(spark, name):
    from patchlens.plans.catalog import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("MapInArrow")] if "MapInArrow" in plan else plan  # end_to_end: above the parse stage
    terms = plan[:plan.index("Generate explode(terms")] if "Generate explode(terms" in plan else plan
    assert "SortAggregate" not in terms and " Sort " not in terms and terms.count("HashAggregate") >= 4
