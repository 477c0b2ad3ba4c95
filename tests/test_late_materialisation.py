"""Winners are found from numbers; bodies move once, unsorted."""

import pytest
from pyspark.sql import functions as F

from patchlens.operators.align import last_wins, pair_functions
from patchlens.plans.catalog import QUERIES

ROWS = [("p", 0, "f", 0, "old f 1"), ("p", 0, "f", 5, "old f 2"), ("p", 0, "g", 1, "old g"), ("p", 1, "f", 2, "new f 1"), ("p", 1, "f", 3, "new f 2"),
        ("p", 1, "h", 0, "new h"), ("q", 0, "f", 9, None), ("q", 1, "f", 0, "q new"), (None, 0, "f", 0, "no item"), (None, 1, "f", 0, "no item either"),
        ("r", 0, None, None, None)]


@pytest.fixture
def functions(spark):
    return spark.createDataFrame(ROWS, "pair_id string, version int, func string, walk_ord int, body string").repartition(3)


def test_last_definition_wins(functions):
    got = {(r.pair_id, r.version, r.func): (r.body, r.walk_ord, r.first_ord) for r in last_wins(functions).collect()}
    assert got == {("p", 0, "f"): ("old f 2", 5, 0), ("p", 0, "g"): ("old g", 1, 1), ("p", 1, "f"): ("new f 2", 3, 2), ("p", 1, "h"): ("new h", 0, 0),
                   ("q", 0, "f"): (None, 9, 9), ("q", 1, "f"): ("q new", 0, 0), (None, 0, "f"): ("no item", 0, 0), (None, 1, "f"): ("no item either", 0, 0)}
    assert last_wins(functions.limit(0)).count() == 0


def test_names_of_both_versions(functions):
    got = {(r.pair_id, r.func): (r.first_ord, r.old_walk, r.new_walk, r.old_body, r.new_body) for r in pair_functions(functions, "body").collect()}
    assert got == {("p", "f"): (0, 5, 3, "old f 2", "new f 2"), ("q", "f"): (9, 9, 0, None, "q new"), (None, "f"): (0, 0, 0, "no item", "no item either")}


@pytest.mark.parametrize("name", ["functions_last_wins", "functions_join"])
def test_plan_moves_no_body_before_the_winners_are_known(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert "SortAggregate" not in plan and "ShuffledHashJoin" in plan
    # the numbers' aggregation reads neither column that a body is made of
    won = plan[plan.rindex("HashAggregate"):]
    assert "o_orderstatus" not in won and "o_orderpriority" not in won


def test_runtime_filter_cuts_off_losers(spark):
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
            F.col("o_custkey").alias("pair_id"), (F.col("o_orderkey") % 2).alias("version"), (F.col("o_orderkey") % 7).alias("func"),
            F.col("o_orderkey").alias("walk_ord"), F.col("o_orderpriority").alias("body"))
        plan = pair_functions(orders.where("pair_id < 20"), "body")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "bloomfilter" in plan.lower()
