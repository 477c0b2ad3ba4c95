"""What large inputs depend on: generated methods that the JVM compiles, and terms that no aggregation holds."""

import pytest
from pyspark.sql import functions as F

from patchlens.operators.similarity import LEXICAL_MODELS, score_lexical
from patchlens.plans.catalog import QUERIES


def largest_method(spark, df) -> int:
    plan = df._jdf.queryExecution().executedPlan()
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["diff_conditions", "render_sentences"])
def test_no_stage_is_left_to_the_interpreter(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_method(spark, QUERIES[name](spark, "/root/testdata/sf0.001")) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_terms_never_become_rows_of_an_aggregation(spark):
    rows = [("1", "a b a", "a c"), ("1", "b", None), ("2", "ab\U0001f600cd", "ab\U0001f600cd"), (None, "a b", "b a"), ("3", None, "x"), ("4", "", "")]
    pairs = spark.createDataFrame(rows, "pair_id string, summary string, explanation string")
    out = score_lexical(pairs, models=LEXICAL_MODELS)
    assert "explode(terms" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.pair_id, r.model): (r.score and round(r.score, 6), r.error) for r in out.where(F.col("model") != "word_bigram_tf").collect()}
    # the rows of key 1 count together: a 2, b 2 against a 1, c 1
    assert got == {("1", "word_tf"): (0.5, None), ("1", "char3_tf"): (0.0, None), ("2", "word_tf"): (1.0, None), ("2", "char3_tf"): (1.0, None),
                   (None, "word_tf"): (1.0, None), (None, "char3_tf"): (0.0, None), ("3", "word_tf"): (None, "empty_text"),
                   ("3", "char3_tf"): (None, "empty_text"), ("4", "word_tf"): (None, "empty_text"), ("4", "char3_tf"): (None, "empty_text")}


def test_fields_that_no_rule_reads_are_not_made(spark):
    """Nodes given by their fields' columns: a ``while`` has only its test made, and the records are those of whole nodes."""
    from patchlens.operators.rules import diff_nodes
    from patchlens.schemas import NODE

    def fields(side, unread):
        texts = {"kind": F.col("kind"), "text": F.col(f"{side}_text"), "test": F.col(f"{side}_test"), "has_body": F.lit(True),
                 "targets": F.array(F.col(f"{side}_text")), "value": F.col(f"{side}_test"), "docstring": F.col(f"{side}_text")}
        blank = lambda f: F.when(F.col("kind") == "While", F.raise_error(F.lit(f"{f.name} was made"))) if unread else F.lit(None)
        return {f.name: texts.get(f.name, blank(f)).cast(f.dataType) for f in NODE.fields}

    pairs = spark.createDataFrame([(1, "While", "a", "b", "x", "y"), (2, "While", "a", "a", "x", "x"), (2, "While", "a", "a", "x", "x"),
                                   (None, "Assign", "a", "b", "x", "y"), (4, "If", "a", None, "x", "y"), (5, "With", "a", "b", "x", "x"), (6, None, "a", "b", "x", "y")],
                                  "k int, kind string, o_text string, n_text string, o_test string, n_test string")
    for mode in ("reference", "strict"):
        got = diff_nodes(pairs, mode, fields("o", True), fields("n", True), keys=["k"])
        whole = pairs.select("k", *[F.struct(*[c.alias(f) for f, c in fields(side, False).items()]).alias(name) for side, name in (("o", "old"), ("n", "new"))])
        want = diff_nodes(whole, mode)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert {(r.k, r.rule) for r in got.collect()} >= {(1, "R25"), (None, "R20"), (4, "R02"), (5, "R33")}


def test_pairs_that_no_rule_can_take_are_dropped_before_nodes_are_made(spark):
    """Fields of such pairs are never computed, not even those read of their kinds; null and odd kinds keep the records they had."""
    from patchlens.operators.rules import diff_nodes
    from patchlens.schemas import NODE

    def fields(side):
        kind, fails = F.col(f"{side}_kind"), F.when(F.col("k") == 0, F.raise_error(F.lit("made"))).otherwise(F.col(f"{side}_text"))
        made = {"kind": kind, "has_body": kind.isin("With", "For"), "test": fails, "target": fails, "iter": fails, "docstring": fails}
        return {f.name: made.get(f.name, F.lit(None)).cast(f.dataType) for f in NODE.fields}

    rows = [(0, "For", "Expr", "a", "b"), (0, "Expr", "For", "a", "b"), (0, "Expr", "Expr", "a", "b"), (0, None, None, "a", "b"), (0, "While", None, "a", "b"),
            (1, "For", "With", "a", "b"), (2, "While", "While", "a", "b"), (3, "Expr", "If", "a", "b"), (4, None, "If", "a", "b"), (5, "For", "For", "a", "a")]
    pairs = spark.createDataFrame(rows, "k int, o_kind string, n_kind string, o_text string, n_text string")
    got = {(r.k, r.rule) for r in diff_nodes(pairs, old=fields("o"), new=fields("n"), keys=["k"]).collect()}
    assert got == {(1, "R33"), (2, "R25"), (3, "R01")}


def test_lineitem_is_shuffled_as_read(spark):
    """The view's window takes the rows as they were dealt: one exchange, of the seven columns read."""
    plan = QUERIES["diff_exceptions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "Project" not in below and "FLOOR" not in below
