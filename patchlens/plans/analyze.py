"""Whole-corpus plans: items or versions -> change rows -> item texts -> scores.

An item's two versions are parsed together in one Arrow stage that also keeps the last
definition of a name, matches old and new and aligns their statements, so syntax facts are never shuffled. Change
records are shuffled once, as text, on the item key; scores are counted on that partitioning.
Building these plans runs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import NEW, OLD, function_changes
from ..operators.deal import deal_by_cost
from ..operators.extract import extract_pairs
from ..operators.render import item_texts
from ..operators.similarity import MATCH_THRESHOLD, score_lexical
from ..schemas import STATUS_NO_BUG, STATUS_OK, STATUS_PARSE_ERROR, STATUS_REPLY_MISSING
from ..sources.replies import parse_replies
from ..sources.tree import ITEMS_A_PARTITION, named_items, read_sources, with_outcome


def pair_versions(versions: DataFrame) -> DataFrame:
    """(pair_id, version, source) -> (pair_id, old, new): the source text is shuffled once."""
    side = lambda v: F.max(F.when(F.col("version") == v, F.col("source")))
    return versions.groupBy("pair_id").agg(side(OLD).alias("old"), side(NEW).alias("new"))


def _dealt(items: DataFrame, partitions: int | None, by_cost: bool) -> DataFrame:
    if not partitions:
        return items
    if not by_cost:
        return items.repartition(partitions)
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return deal_by_cost(items, partitions, size("old") + size("new"))


def analyze_pairs(items: DataFrame, mode: str = "reference", partitions: int | None = None, by_cost: bool = False) -> DataFrame:
    """(pair_id, old, new) -> change rows (pair_id, func, first_ord, phase, pos, seq, payload).

    ``partitions`` deals the items out before parsing, for inputs with few, fat splits: by their number, or with ``by_cost``
    by the length of their sources, which is measured in a pass of its own. Mode ``extended`` adds records of the
    expressions inside aligned statements: strings, formatted strings, calls and attributes.
    """
    items = _dealt(items, partitions, by_cost)
    slots = extract_pairs(items, mode=mode).where(F.col("func").isNotNull()).drop("error")
    return function_changes(slots, mode)


def analyze_corpus(versions: DataFrame, mode: str = "reference", partitions: int | None = None) -> DataFrame:
    """(pair_id, version, source) -> change rows."""
    return analyze_pairs(pair_versions(versions), mode, partitions)


def parse_status(functions: DataFrame) -> DataFrame:
    """(pair_id, version, status, error) for files the parser rejected."""
    return functions.where(F.col("error").isNotNull()).select(
        "pair_id", "version", F.lit(STATUS_PARSE_ERROR).alias("status"), "error")


def run_items(items: DataFrame, replies: DataFrame | None = None, mode: str = "reference",
              models: dict | None = None, threshold: float = MATCH_THRESHOLD,
              partitions: int | None = None, by_cost: bool = False) -> dict[str, DataFrame]:
    """End to end for items with a buggy source and a model reply.

    ``items``: (pair_id, source, reply) - or (pair_id, source) with ``replies``
    (pair_id, reply) joined on the key; one row per pair_id. Items may bring (known_status, known_error)
    of earlier checks: one that is not ``ok`` stays the item's outcome. Returns lazily planned frames:
    ``items`` (one outcome per item: pair_id, status, error, explanation, summary,
    changes_json, n_functions, n_changes), ``changes`` (change rows) and ``scores`` (per
    usable or unparsable item and model). The outcomes and scores come from one pass over the
    items: what is needed of an item beside its functions travels on a row of its own.
    """
    if replies is not None:
        items = items.select("pair_id", "source").join(replies.select("pair_id", "reply"), "pair_id")
    known = "known_status" in items.columns
    parsed = parse_replies(items.select("pair_id", "source", "reply", *(("known_status", "known_error") if known else ())))
    carry = ("status", "explanation")
    if known:
        failed = F.col("known_status") != STATUS_OK
        parsed = parsed.withColumn("status", F.when(failed, F.col("known_status")).otherwise(F.col("status"))).withColumn(
            "fixed", F.when(~failed, F.col("fixed")))
        carry += ("known_error",)
    # a reply without code leaves nothing to compare
    both = parsed.select("pair_id", F.when(F.col("fixed").isNotNull(), F.col("source")).alias("old"), F.col("fixed").alias("new"), *carry)
    both = _dealt(both, partitions, by_cost)
    slots = extract_pairs(both, carry=carry, mode=mode)
    records = function_changes(slots, mode, keep_items=True)
    outcome = item_texts(records, carry=(*carry, "error"))
    outcome = outcome.withColumn("status", F.when(F.col("error").isNotNull(), F.lit(STATUS_PARSE_ERROR)).otherwise(F.col("status")))
    if known:
        outcome = outcome.withColumn("error", F.coalesce("error", "known_error")).drop("known_error")
    usable = outcome.where(F.col("status").isin(STATUS_OK, STATUS_NO_BUG, STATUS_PARSE_ERROR)).select(
        "pair_id", F.when(F.col("error").isNull(), F.col("summary")).alias("summary"),
        F.when(F.col("error").isNull(), F.coalesce("explanation", F.lit(""))).alias("explanation"), "error")
    scores = score_lexical(usable, "pair_id", "summary", "explanation", models, threshold, error="error")
    return {"items": outcome, "changes": records.where(F.col("rule").isNotNull()).drop(*carry, "error"), "scores": scores}


def run_tree(spark: SparkSession, root: str, patches: str, replies: DataFrame, mode: str = "reference",
             models: dict | None = None, threshold: float = MATCH_THRESHOLD, items_a_partition: int = ITEMS_A_PARTITION) -> dict[str, DataFrame]:
    """From a checkout tree to results: the frames of ``run_items`` for every bug folder under ``root``.

    ``replies``: (project, bug_id, reply). Each item has one outcome, the first check that fails: ``patch_missing``,
    ``no_path``, ``file_missing``, ``reply_missing``, ``no_delimiter``, ``parse_error``; or ``no_bug`` or ``ok``. Diffs' first
    lines are joined with the replies before any source is read, so a source is opened once and never shuffled.
    ``pair_id`` is ``<project>/<bug>``.
    """
    answers = replies.select("project", F.col("bug_id").cast("long").alias("bug_id"), "reply")
    named = named_items(spark, root, patches, items_a_partition).join(answers, ["project", "bug_id"], "left")
    found = with_outcome(read_sources(named, root))
    missing = (F.col("status") == STATUS_OK) & F.col("reply").isNull()
    name = F.concat_ws("/", "project", F.col("bug_id").cast("string"))
    items = found.select(
        name.alias("pair_id"), "source", "reply",
        F.when(missing, F.lit(STATUS_REPLY_MISSING)).otherwise(F.col("status")).alias("known_status"),
        F.when(missing, F.concat(F.lit(STATUS_REPLY_MISSING + ": "), name)).otherwise(F.col("error")).alias("known_error"))
    return run_items(items, mode=mode, models=models, threshold=threshold)
