"""Terms that are neighbours in a text are counted as numbers, from parts that are made once."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from patchlens.operators import similarity
from patchlens.operators.similarity import LEXICAL_MODELS, char_ngrams, ngram_sums, score_lexical
from patchlens.plans.catalog import QUERIES
from patchlens.plans.flagship import corpus_inputs

ALPHABET = list("ab cd_1é\n\t.ß東٣") + ["\U0001f600", "İ", "\x00", "  "]


def text(rng):
    return None if rng.random() < 0.1 else "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 3, 5, 30, 200])))


def brute(rows, n):
    def grams(texts):
        return Counter(tuple(p[k:k + n]) for t in texts or () for p in [[x for x in t or () if x]] for k in range(len(p) - n + 1))
    for left, right in rows:
        a, b = grams(left), grams(right)
        yield {"dot": float(sum(a[g] * b[g] for g in a)), "na": float(sum(x * x for x in a.values())), "nb": float(sum(x * x for x in b.values()))}


@pytest.mark.parametrize("kind", ["characters", "words"])
def test_sums_are_those_of_counted_terms(kind):
    rng = random.Random(7)
    one = (lambda: text(rng)) if kind == "characters" else (
        lambda: None if rng.random() < 0.1 else [rng.choice(["", "a", "b", "ab", "é", None]) for _ in range(rng.randrange(9))])
    side = lambda: None if rng.random() < 0.1 else [one() for _ in range(rng.choice([0, 1, 1, 1, 3]))]
    rows = [(side(), side()) for _ in range(300)]
    kinds = pa.list_(pa.string() if kind == "characters" else pa.list_(pa.string()))
    for some in (rows, [], [(None, None)], [([], [None])]):
        columns = [pa.array([r[k] for r in some], kinds) for k in (0, 1)]
        for n, got in zip((1, 2, 3, 9), ngram_sums(*columns, [1, 2, 3, 9])):
            assert got.to_pylist() == list(brute(some, n)), n


def test_numbers_that_would_be_too_large_are_made_small_again():
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))
    rows = [([wide, wide[::-1]], [wide[5:] + "x"])]
    got = ngram_sums(*[pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1)], [7])[0]
    assert got.to_pylist() == list(brute(rows, 7))


def test_scores_are_those_of_the_terms(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_ROWS", 7)
    rng = random.Random(1)
    rows = [(rng.choice([None, *map(str, range(90))]), text(rng), text(rng), rng.choice([None, None, "bad"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "pair_id string, summary string, explanation string, e string")
    models = LEXICAL_MODELS | {"char5": char_ngrams(5)}
    # without what they are made of, tokenizers give their terms
    plain = {name: (lambda c, tok=tok: tok(c)) for name, tok in models.items()}
    for more in ({}, {"error": "e"}, {"normalise_text": False}):
        assert sorted(map(str, score_lexical(df, models=models, **more).collect())) == sorted(map(str, score_lexical(df, models=plain, **more).collect()))
    mixed = {"word_tf": models["word_tf"], "char3_tf": plain["char3_tf"]}
    assert sorted(map(str, score_lexical(df, models=mixed).collect())) == sorted(
        str(r) for r in score_lexical(df).collect() if r.model in mixed)


@pytest.mark.parametrize("name", ["end_to_end", "score_lexical", "score_pairs"])
def test_each_text_is_split_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("L}") == 2  # a side each


def test_lineitem_is_dealt_by_order_as_read(spark):
    """An order's lines are few bytes and much parsing, so tasks are not merged by bytes."""
    for out in (corpus_inputs(spark, "/root/testdata/sf0.001"), QUERIES["diff_expressions"](spark, "/root/testdata/sf0.001")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
        assert "Project" not in plan[plan.index("Exchange"):]
