"""The hashed encoder against plain Python, its plan, and stored models and vectors."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchlens.operators.encoder import MOST_FEATURES, HashedIdf, bucket_of, encode, fit_hashed_idf, score_vectors, sparse_cosine
from patchlens.operators.similarity import LEXICAL_MODELS, score_lexical, score_pairs

TEXTS = [(1, "the cat sat on the mat"), (2, "The dog sat"), (3, ""), (4, None), (5, "ünd ÜND über"), (6, "cat " * 5000), (7, "!!! ???")]


def buckets(text, features):
    return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % features for w in re.split(r"[^\w]+", text.strip().lower()) if w]


def fitted(features):
    texts = [t for _, t in TEXTS if t is not None]
    df = Counter(b for t in texts for b in set(buckets(t, features)))
    return lambda b: math.log((len(texts) + 1) / (df.get(b, 0) + 1))


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("features", [1 << 18, 7])
def test_vectors_equal_brute_force(texts, features):
    weight = fitted(features)
    got = {r.doc_id: r.vector for r in encode(texts, fit_hashed_idf(texts, features=features)).collect()}
    assert set(got) == {i for i, _ in TEXTS} and got[4] is None
    for i, t in TEXTS:
        if t is not None:
            want = sorted((b, n * weight(b)) for b, n in Counter(buckets(t, features)).items())
            assert got[i].size == features and got[i].indices == [b for b, _ in want]
            assert all(abs(x - y) < 1e-9 for x, (_, y) in zip(got[i].values, want))


def cosine(a, b, features):
    weight = fitted(features)
    x, y = ({k: n * weight(k) for k, n in Counter(buckets(t, features)).items()} for t in (a, b))
    na, nb = (math.sqrt(sum(v * v for v in m.values())) for m in (x, y))
    return sum(v * y.get(k, 0) for k, v in x.items()) / (na * nb) if na and nb else None


def test_scores_beside_the_other_models(spark, texts):
    model = fit_hashed_idf(texts, features=1 << 12)
    pairs = [("1", "the cat sat", "a cat sat over there"), ("2", "dog", "über new words"), ("3", "", "x"), ("4", "cat mat", "cat mat")]
    df = spark.createDataFrame(pairs, "pair_id string, summary string, explanation string")
    got = {(r.pair_id, r.model): r for r in score_lexical(df, models=LEXICAL_MODELS | {"hashed_idf": model}).collect()}
    assert len(got) == 16
    plain = {(r.pair_id, r.model): r.score for r in score_lexical(df).collect()}
    for p, a, b in pairs:
        want, r = cosine(a, b, 1 << 12), got[p, "hashed_idf"]
        assert (r.score is None and r.error == "empty_text") if want is None else abs(r.score - want) < 1e-12
        assert all(got[p, m].score == plain[p, m] for m in LEXICAL_MODELS)
    sides = df.select("pair_id", "summary"), df.select("pair_id", "explanation")
    assert {(r.pair_id, r.is_match) for r in score_pairs(*sides, models={"h": model}).collect()} == {
        (p, (cosine(a, b, 1 << 12) or 0) >= 0.6) for p, a, b in pairs}


def test_stored_vectors_score_like_texts(spark, texts, tmp_path):
    model = fit_hashed_idf(texts, features=1 << 10)
    encode(texts, model).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    both = v.alias("a").crossJoin(v.alias("b")).select(F.concat_ws("-", "a.doc_id", "b.doc_id").alias("pair_id"),
                                                       F.col("a.vector").alias("x"), F.col("b.vector").alias("y"))
    for r in score_vectors(both, "pair_id", "x", "y").collect():
        a, b = (dict(TEXTS)[int(k)] for k in r.pair_id.split("-"))
        want = None if a is None or b is None else cosine(a, b, 1 << 10)
        assert r.score is None and r.error if want is None else abs(r.score - want) < 1e-9, r.pair_id
    sizes = both.where("pair_id = '1-1'").withColumn("y", F.col("y").withField("size", F.lit(3)))
    assert sizes.select(sparse_cosine(F.col("x"), F.col("y"))).first()[0] is None


def test_saved_models_come_back(spark, texts, tmp_path):
    model = fit_hashed_idf(texts, features=64)
    model.save(str(tmp_path / "m"))
    again = HashedIdf.load(spark, str(tmp_path / "m"))
    assert (again.features, again.n_texts) == (64, 6)
    assert sorted(again.weights.collect()) == sorted(model.weights.collect())
    empty = fit_hashed_idf(texts.limit(0))
    assert empty.n_texts == 0 and encode(texts, empty).count() == len(TEXTS)
    for wrong in (0, MOST_FEATURES + 1):
        with pytest.raises(ValueError, match="features"):
            fit_hashed_idf(texts, features=wrong)


def test_terms_are_never_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = encode(docs, fit_hashed_idf(docs))._jdf.queryExecution().executedPlan().toString()
    encoding, fitting = plan.split("BroadcastExchange")
    # one exchange of texts by their key above the terms; fitting exchanges counted buckets only
    assert encoding.count("Exchange hashpartitioning(doc_id") + fitting.count("Exchange hashpartitioning(doc_id") == 1
    assert "Exchange hashpartitioning(bucket" in fitting and "Sort " not in plan and "SortAggregate" not in plan


def test_terms_of_a_task_are_never_rows_of_an_aggregation(spark):
    """Texts are gathered by key and counted in Arrow batches; keys may repeat, be null, or have a null text beside others."""
    rows = [(1, "a b a"), (1, "b c"), (1, None), (2, None), (3, ""), (None, "a"), (None, "a d")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_hashed_idf(d, features=1 << 10)
    out = encode(d, model)
    encoding = out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    aggregates = [line for line in encoding.splitlines() if "Aggregate(" in line]
    assert aggregates and all("collect_list(_t" in line for line in aggregates)
    weight = {r.bucket: r.weight for r in model.weights.collect()}
    at = {w: spark.range(1).select(bucket_of(F.lit(w), 1 << 10)).first()[0] for w in "abcd"}

    def vector(**counts):
        return sorted((at[w], n * weight[at[w]]) for w, n in counts.items())

    got = sorted((str(r.doc_id), r.vector is None, [] if r.vector is None else [*zip(r.vector["indices"], r.vector["values"])]) for r in out.collect())
    assert got == sorted([("1", False, vector(a=2, b=2, c=1)), ("1", True, []), ("2", True, []), ("3", False, []), ("None", False, vector(a=2, d=1))])


@pytest.mark.parametrize("batch", [1, 2, 3, 100])
def test_vectors_are_put_together_across_batches(batch):
    import pyarrow as pa

    from patchlens.operators.encoder import _gathered
    vectors = [("a", [(1, 0.5), (2, 1.5), (9, 2.0)]), ("b", []), ("c", [(4, 1.0)]), (None, []), ("d", [(3, 0.0), (5, 1.0)])]
    rows = [(k, True, p, b, v) for k, terms in vectors for p, (b, v) in (enumerate(terms) if terms else [(None, (None, None))])]
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64()]
    made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["_k", "_has", "pos", "bucket", "value"])
    got = [r for b in _gathered(made.slice(k, batch) for k in range(0, len(rows), batch)) for r in b.to_pylist()]
    assert [(r["_k"], [*zip(r["indices"], r["values"])]) for r in got] == vectors
    assert not [r for b in _gathered(iter([made.slice(0, 0)])) for r in b.to_pylist()]
