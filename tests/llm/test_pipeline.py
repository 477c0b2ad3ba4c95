"""The pipeline's stages, each against what its operator decides on the stage's own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from patchlens.llm import pii, simhash
from patchlens.llm.common import settled, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(9001, "123 456 !!", "en", "s", 10), (9002, None, "en", "s", 0), (None, "The cat and the dog were here", "en", "s", 29)],
                                  docs.schema)
    docs, seen = docs.unionByName(extra), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = settled(stage(spark, docs, SF))
        seen.append(name)
        if name == "language":
            assert docs.where("doc_id is null or doc_id > 9000").count() == 0
        if name == "near_duplicates":
            groups = simhash.near_duplicates(before, 4, 4)
            assert docs.count() == groups.select("component_id").distinct().count()
            assert docs.join(groups, "doc_id").where("doc_id <> component_id").count() == 0
        if name == "personal_data":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in docs.collect():
                t = texts[r["doc_id"]]
                assert r["text"] == pii.masked(t, pii.spans(t)) and r["n_chars"] == len(r["text"])
        if name != "packing":
            assert docs.columns == before.columns
            kept = docs
    assert seen == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    assert kept.count() > 100
    assert docs.select("doc_id").distinct().count() == kept.count()
    fill = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fill <= 4096


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = ("the cat sat on the mat by the door", "seven ships sailed out of the harbour at dawn", "bread and salt were all that they had left")
    rows = [(1, a), (2, a), (2, b), (1, c), (1, c), (3, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SF, "documents").schema)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(1, a), (2, b), (1, c)])


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
