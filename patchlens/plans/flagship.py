"""The whole chain on driver data: generated Python files, model replies, change sets,
summaries and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .analyze import run_items


def lines_by_order(spark: SparkSession, sf_dir: str) -> None:
    """``lineitem`` dealt out by order as it is read, where the views' windows would shuffle the columns that they make. The number of partitions is
    given: an order's lines are few bytes and much parsing, so tasks merged by bytes would leave cores idle at the end."""
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(tasks, "l_orderkey").createOrReplaceTempView("lineitem")


def corpus_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items (pair_id, source, reply) built from ``lineitem``: one Python file per order; the
    reply edits assigned values, returns or conditions of its definitions, wraps the code in a
    fence and appends an explanation, sometimes in the summary's own words (or is the no-bug
    sentinel)."""
    lines_by_order(spark, sf_dir)
    buggy = spark.sql(V.sources_sql("spark"))
    src = F.col("source")
    k = F.col("pair_id").cast("bigint")
    fixed = F.when(k % 3 == 0, F.regexp_replace(src, r"(?m)^(    x = )(\d+)$", "$1$2 + 1")) \
        .when(k % 3 == 1, F.regexp_replace(src, r"(?m)^(    return x )\+", "$1-")) \
        .when(k % 2 == 0, F.regexp_replace(src, r"(?m)^(    if x )>", "$1>=")) \
        .otherwise(src)
    reply = F.when(k % 7 == 5, F.lit("NO BUGS FOUND")).otherwise(
        F.concat(F.lit("Fixed Code:\n```python\n"), fixed, F.lit("\n```\n---EXPLANATION---\n"), F.expr(V.explanation_sql("k"))))
    return buggy.withColumn("k", k).select("pair_id", "source", reply.alias("reply"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_items(corpus_inputs(spark, sf_dir))
    return out["scores"].select("pair_id", "model", F.round("score", 4).alias("score"), "shown", "is_match",
                                F.regexp_extract("error", r"^(\w+)", 1).alias("error"))
