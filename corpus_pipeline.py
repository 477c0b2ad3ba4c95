"""A training corpus from ``documents``: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the
columns of ``documents``.

Edge cases: a row without a doc_id goes in the first stage, since no later result could name it; texts that are null or hold no
letter are of no language and go there too; rows of one doc_id are told apart by their text, and equal ones leave the near-duplicate
stage once; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import language, packing, pii, quality, simhash
from patchlens.llm.common import bucket, settled, table

#: Below this posterior a text is in no language that the corpus teaches.
LEAST_LANGUAGE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a doc_id and a language; learns from the stage's own input."""
    model = language.fit(docs, lambda key: bucket(key, 5) != 0)
    known = language.annotate(docs, model, "text", "_pred", "_score")
    return known.where(F.col("doc_id").isNotNull() & (F.col("_pred") != language.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE)).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the operator's threshold; learns from the labels of the stage's own input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda key: bucket(key, 4) != 2)
    scored = quality.with_evidence(docs, model.bad, model.good, "text", "_evidence")
    return scored.where(quality.probability(F.col("_evidence"), model) >= quality.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints: the one with its smallest doc_id, of the smallest text hash if that is repeated."""
    row = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    marked = docs.where("doc_id is not null").withColumn("_row", row)
    groups = simhash.near_duplicates(marked.select("_row", "text"), shingle=4, max_bits=4, key="_row")
    first = groups.where("_row = component_id").groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"))
    kept = marked.join(first, "_row")
    again = kept.where("_copies > 1").dropDuplicates(["_row"])
    return kept.where("_copies = 1").unionByName(again).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data, plain or disguised, replaced by its kind; n_chars follows."""
    return pii.mask(docs, "text", "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most 4096 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settled(docs)
    return docs
