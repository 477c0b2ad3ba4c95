"""Tasks of equal cost."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from patchlens.operators.deal import FINE, deal_by_cost, levelled
from patchlens.plans.analyze import analyze_pairs, run_items


def costs_of(df, cost):
    return [r.c for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(cost).alias("c")).collect()]


@pytest.mark.parametrize("sizes", [
    [10] * 5000,
    [4451 * 40] * 3 + [300] * 4000,  # a few files of thousands of lines
    [int(200_000 / (k + 1)) + 50 for k in range(4000)],
    [k % 997 for k in range(6000)]])
def test_partitions_are_level(spark, sizes):
    df = spark.createDataFrame([(f"p/{k}", n) for k, n in enumerate(sizes)], "pair_id string, n int")
    dealt = deal_by_cost(df, 8, F.col("n"))
    assert sorted(r.n for r in dealt.collect()) == sorted(sizes) and dealt.columns == df.columns
    got = costs_of(dealt, "n")
    # no task longer than half as much again as the middle one, unless one item alone is
    assert len(got) == 8 and max(got) <= max(1.5 * median(got), 1.05 * max(sizes))
    by_count = costs_of(df.repartition(8), "n")
    assert max(got) <= max(by_count) * 1.1


def test_dear_items_are_few_and_placed_dearest_first():
    placed, owner = levelled([("a", 50.0), ("b", 30.0), ("c", 25.0)], 120.0, 2)
    assert placed == {"a": 0, "b": 1, "c": 1} and abs(owner.count(0) - owner.count(1)) > 0
    assert levelled([], 0.0, 3)[0] == {} and set(levelled([], 0.0, 3)[1]) == {0, 1, 2}


def test_odd_items(spark):
    df = spark.createDataFrame([(None, 5), ("a", None), ("b", 900), ("b", 900), ("c", 1)], "pair_id string, n int")
    dealt = deal_by_cost(df, 3, F.col("n"))
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    together = dealt.where("pair_id = 'b'").select(F.spark_partition_id()).distinct().count()
    assert together == 1 and deal_by_cost(df.limit(0), 3, F.col("n")).count() == 0 and FINE > 1


def test_analyses_are_the_same_however_dealt(spark):
    rows = [(str(k), "def f():\n" + "    x = 1\n" * (1 + 300 * (k % 20 == 0)) + "    return 1\n", "def f():\n" + "    x = 1\n" * (1 + 300 * (k % 20 == 0)) + "    return 2\n")
            for k in range(60)]
    df = spark.createDataFrame(rows, "pair_id string, old string, new string")
    key = lambda r: (r.pair_id, r.rule)
    assert sorted(map(key, analyze_pairs(df, partitions=4, by_cost=True).collect())) == sorted(map(key, analyze_pairs(df).collect()))
    items = df.select("pair_id", F.col("old").alias("source"), F.concat("new", F.lit("---EXPLANATION---x")).alias("reply"))
    assert run_items(items, partitions=4, by_cost=True)["items"].where("n_changes = 2").count() == 60


def test_small_rows_with_large_sources_are_parsed_by_many_tasks(spark):
    from patchlens.plans.catalog import QUERIES
    found = QUERIES["extract_odd_functions"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p"), "func")
    assert found.select("p").distinct().count() >= 2 * spark.sparkContext.defaultParallelism
    assert found.count() == 400
