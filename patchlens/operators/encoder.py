"""M1: a fixed-width text encoder by the hashing trick, with fitted document frequencies.

Every term falls into one of ``features`` buckets, by the first 32 bits of its MD5, so a model needs no vocabulary and any text
has a vector. A bucket weighs ln((n + 1) / (df + 1)), n texts being fitted, df of which hold one of its terms. A vector is sparse: ``size``, sorted
``indices``, and ``values`` = count times weight.

Fitting counts buckets, partially in each task, so at most ``features`` numbers leave a task whatever the text. A model is a
table of at most ``features`` rows, the proven bound under which it is broadcast (``MOST_FEATURES``). Terms themselves are never
shuffled, nor are they rows of an aggregation: a text's buckets are counted where it lies, in Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise
from .similarity import ERROR_EMPTY_TEXT, lists_by_row, words

FEATURES = 1 << 18
#: Beyond this a model would be too large to broadcast.
MOST_FEATURES = 1 << 21
VECTOR = "struct<size:int,indices:array<int>,values:array<double>>"
_VECTOR = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())),
                        T.StructField("values", T.ArrayType(T.DoubleType()))])


def bucket_of(term: Column, features: int) -> Column:
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(features)).cast("int")


@dataclass(frozen=True)
class HashedIdf:
    """A fitted encoder; ``weights`` has (bucket, weight) of the buckets that occurred."""

    features: int
    n_texts: int
    weights: DataFrame
    tokens: Callable[[Column], Column] = words

    @property
    def unseen(self) -> float:
        """Weight of a bucket that no fitted text holds."""
        return math.log(self.n_texts + 1)

    def terms(self, text: Column) -> Column:
        """The buckets of a (normalised) text's terms, as strings: this is the tokenizer of a lexical model."""
        return F.transform(self.tokens(text), lambda t: bucket_of(t, self.features).cast("string"))

    def save(self, path: str) -> None:
        """The table of weights, and what else makes the model on a row of its own."""
        head = json.dumps({"features": self.features, "n_texts": self.n_texts})
        rows = self.weights.select("bucket", "weight", F.lit(None).cast("string").alias("model"))
        spark = self.weights.sparkSession
        own = spark.createDataFrame([(None, None, head)], "bucket int, weight double, model string")
        rows.unionByName(own).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = words) -> HashedIdf:
        rows = spark.read.parquet(path)
        head = json.loads(rows.where("model is not null").first()["model"])
        return cls(head["features"], head["n_texts"], rows.where("model is null").select("bucket", "weight"), tokens)


def fit_hashed_idf(texts: DataFrame, text: str = "text", features: int = FEATURES, tokens: Callable[[Column], Column] = words,
                   normalise_text: bool = True) -> HashedIdf:
    """Document frequencies of the buckets over the non-null texts."""
    if not 0 < features <= MOST_FEATURES:
        raise ValueError(f"features must be from 1 to {MOST_FEATURES}")
    rows = texts.select((normalise(F.col(text)) if normalise_text else F.col(text)).alias("_t")).where(F.col("_t").isNotNull())
    n = texts.where(F.col(text).isNotNull()).count()
    held = rows.select(F.explode(F.array_distinct(F.transform(tokens(F.col("_t")), lambda t: bucket_of(t, features)))).alias("bucket"))
    weights = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).select(
        "bucket", F.log(F.lit(float(n + 1)) / (F.col("df") + 1)).alias("weight"))
    return HashedIdf(features, n, weights, tokens)


def counted(buckets: pa.Array, features: int) -> pa.Array:
    """Lists of buckets to lists of (bucket, times), sorted; a null bucket counts nothing."""
    lengths = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
    row, flat = np.repeat(np.arange(len(buckets), dtype="int64"), lengths), buckets.flatten()
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    place, times = np.unique(row * features + flat.to_numpy(zero_copy_only=False), return_counts=True)
    return lists_by_row(place // features, len(buckets), bucket=pa.array((place % features).astype("int32")), times=pa.array(times))


def _counts(buckets: Column, features: int) -> Column:
    return F.arrow_udf(lambda lists: counted(lists, features), "array<struct<bucket:int,times:long>>")(buckets)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, has, pos, bucket, value), a vector's in a row from the one that is its first (``pos`` 0, or null without a term), to vectors."""
    def vectors(held: list[pa.RecordBatch], starts: np.ndarray) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        there = rows.column("bucket").is_valid().to_numpy()
        ends = pa.array(np.r_[0, np.cumsum(there)][np.r_[starts, len(there)]].astype("int32"))
        lists = [pa.ListArray.from_arrays(ends, rows.column(c).drop_null().combine_chunks()) for c in ("bucket", "value")]
        own = rows.select([0, 1]).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in own.columns], *lists], names=[*own.column_names, "indices", "values"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        firsts = np.flatnonzero(pc.fill_null(batch.column(2), 0).to_numpy() == 0)
        if len(firsts) and (firsts[-1] or held):
            last = firsts[-1]
            held.append(batch.slice(0, last))
            # what is held begins with a vector's first row
            before = sum(b.num_rows for b in held[:-1])
            starts = np.r_[[0] if before else [], before + firsts[:-1]].astype("int64")
            yield vectors(held, starts)
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield vectors(held, np.zeros(1 if sum(b.num_rows for b in held) else 0, "int64"))


def encode(texts: DataFrame, model: HashedIdf, key: str = "doc_id", text: str = "text", normalise_text: bool = True) -> DataFrame:
    """(key, vector) of every row, one row for each key; a null text has a null vector, one without terms an empty one.

    The texts are partitioned by the key once, and those of one key gathered as texts. Their buckets are counted in Arrow batches, and pass
    by the broadcast weights in their order, in which a vector is put together again: a task holds texts and one vector, not all their terms.
    """
    t = normalise(F.col(text)) if normalise_text else F.col(text)
    rows = texts.select(F.col(key), t.alias("_t")).repartition(key)
    rows = rows.groupBy(key, F.col("_t").isNotNull().alias("_has")).agg(F.collect_list("_t").alias("_ts"))
    buckets = F.flatten(F.transform("_ts", lambda x: F.transform(model.tokens(x), lambda w: bucket_of(w, model.features))))
    counts = rows.select(key, "_has", F.posexplode_outer(_counts(buckets, model.features)).alias("_pos", "_c"))
    terms = counts.select(key, "_has", "_pos", F.col("_c.bucket").alias("bucket"), F.col("_c.times").alias("n"))
    passed = terms.join(F.broadcast(model.weights), "bucket", "left").select(
        key, "_has", "_pos", "bucket", (F.col("n") * F.coalesce("weight", F.lit(model.unseen))).alias("value"))
    kind = texts.schema[key].dataType
    found = passed.mapInArrow(_gathered, T.StructType([T.StructField(key, kind), T.StructField("_has", T.BooleanType()), *_VECTOR.fields[1:]]))
    vector = F.struct(F.lit(model.features).alias("size"), "indices", "values")
    return found.select(key, F.when(F.col("_has"), vector.cast(VECTOR)).alias("vector"))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors in one sorted pass over their entries; null if either is null or zero, or if their sizes differ."""
    tagged = lambda v: F.transform(F.arrays_zip(v["indices"], v["values"]), lambda e: F.struct(
        e["indices"].alias("i"), e["values"].alias("x")))
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("dot"))
    both = F.array_sort(F.concat(tagged(a), tagged(b)))

    def step(s: Column, e: Column) -> Column:  # an index occurs at most once on a side, so equal neighbours are a pair
        return F.struct(e["i"].alias("i"), e["x"].alias("x"), (s["dot"] + F.when(s["i"] == e["i"], s["x"] * e["x"]).otherwise(0.0)).alias("dot"))

    square = lambda v: F.aggregate(v["values"], F.lit(0.0), lambda s, x: s + x * x)
    na, nb = square(a), square(b)
    return F.when((a["size"] == b["size"]) & (na > 0) & (nb > 0), F.aggregate(both, start, step)["dot"] / (F.sqrt(na) * F.sqrt(nb)))


def score_vectors(pairs: DataFrame, key: str, left: str, right: str, model: str = "hashed_idf", threshold: float | None = None) -> DataFrame:
    """Stored sparse vectors per row -> (key, model, score, shown, is_match, error)."""
    from .similarity import MATCH_THRESHOLD, verdict

    score = sparse_cosine(F.col(left), F.col(right))
    out = pairs.select(F.col(key), F.lit(model).alias("model"), score.alias("score"))
    return out.select(key, "model", "score", *verdict(F.col("score"), MATCH_THRESHOLD if threshold is None else threshold),
                      F.when(F.col("score").isNull(), F.lit(ERROR_EMPTY_TEXT)).alias("error"))
