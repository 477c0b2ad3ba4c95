"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives a vector a long hash string: ``SYMBOLS`` symbols, each the nearest of the 2 * dims signed axes after
a random rotation of its own. A tree is a sorted array of these strings, held in blocks: rows of one first symbol, split
evenly when there are more than ``BLOCK_ROWS``. A query descends in every tree to its longest matching prefixes; then all trees
ascend together, one symbol at a time, until the prefixes they share with the query hold a ``share`` of the indexed classes, ``least`` candidates at the fewest,
or the root is reached. What is searched is thus a share of the table, whatever its size.
Candidates are scored by cosine in double precision where they lie, next to the sorted strings.

Equal vectors are one class that is indexed and queried once; a class keeps its ``k + 1`` smallest ids, which is
all that ``k`` places can show of it, so copies are never paired.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of
another length than the most frequent one (the shorter, if two are); a null id takes no part; ids are
expected to be unique, and rows repeated with the same id count once; ties of score go to the smaller id; with
fewer than ``k`` candidates all are returned; an empty table or an empty query set gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import settled, small_batches

TREES = 40
SYMBOLS = 4
#: Candidates, counted in every tree that has them, at which the ascent stops: this share of the classes, but not fewer than ``LEAST``.
SHARE = 0.05
LEAST = 4096
BLOCK_ROWS = 20_000
SEED = 7


def rotations(dims: int, trees: int = TREES, symbols: int = SYMBOLS) -> np.ndarray:
    """(trees, symbols, dims, dims) random rotations; a size fixed by the parameters."""
    raw = np.random.default_rng(SEED).normal(size=(trees, symbols, dims, dims))
    return np.linalg.qr(raw)[0]


def strings(vectors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """(rows, trees): each hash string as one number, first symbol highest."""
    rows, dims = vectors.shape
    out = np.zeros((rows, turned.shape[0]), np.int64)
    for t, tree in enumerate(turned):
        for rotation in tree:
            y = vectors @ rotation
            axis = np.abs(y).argmax(axis=1)
            out[:, t] = out[:, t] * (2 * dims) + 2 * axis + (y[np.arange(rows), axis] < 0)
    return out


def usable(vector: Column) -> Column:
    """No null, zero, NaN or infinite vector."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dims)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(class_id, ids, vector): each distinct vector with its smallest id and its k + 1 smallest ids. The window's limit is applied
    before the shuffle, so a vector with very many copies moves only k + 1 of each task's."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return (few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
            .select(F.col("ids")[0].alias("class_id"), "ids", "vector"))


def search(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           trees: int = TREES, symbols: int = SYMBOLS, least: int = LEAST, block_rows: int = BLOCK_ROWS,
           share: float = SHARE) -> DataFrame:
    """(query_id, rank, id, score) of each query row's ``k`` nearest other rows found. ``is_query`` is a condition on ``table``."""
    spark = table.sparkSession
    small_batches(spark)
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = sizes["n"] if sizes else 1
    rows = rows.where(F.size("vector") == dims).dropDuplicates(["id"])
    found = settled(classes(rows, k))
    # the classes that some query row belongs to
    asking = rows.where("asks").select("vector").distinct()
    turned = spark.sparkContext.broadcast(rotations(dims, trees, symbols))

    def hashed(batches):
        for batch in batches:
            body = pa.Table.from_batches([batch])
            codes = strings(_matrix(body.column("vector"), dims), turned.value)
            yield body.append_column("codes", pa.array(list(codes), pa.list_(pa.int64()))).to_batches()[0] if body.num_rows else \
                pa.RecordBatch.from_arrays([*batch.columns, pa.array([], pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    kind = table.schema[vector].dataType.simpleString()
    index = settled(found.mapInArrow(hashed, f"class_id long, ids array<long>, vector {kind}, codes array<long>"))
    queries = settled(index.join(asking, "vector", "left_semi"))

    # blocks: rows of a tree and a first symbol, split evenly where they are many
    leaf = (2 * dims) ** (symbols - 1)
    tree_of = lambda df, *more: df.select(F.posexplode("codes").alias("tree", "code"), "class_id", *more).withColumn(
        "first", F.expr(f"code div {leaf}"))
    held = tree_of(index).groupBy("tree", "first").count().collect()  # trees * 2 * dims rows at most
    parts = {(r["tree"], r["first"]): -(-r["count"] // block_rows) for r in held}
    enough = max(least, share * sum(r["count"] for r in held if r["tree"] == 0))
    splits = spark.createDataFrame([(*at, n) for at, n in parts.items()], "tree int, first long, parts long")
    stored = lambda *more: (tree_of(index, *more).join(F.broadcast(splits), ["tree", "first"])
                            .withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts"))).drop("parts"))
    everywhere = lambda df: (df.join(F.broadcast(splits), ["tree", "first"])
                             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts"))
    widths = [(2 * dims) ** (symbols - level) for level in range(symbols + 1)]

    def counted(group: pa.Table) -> pa.Table:
        """For each query, the strings of this block that share each prefix length, by binary search."""
        codes, asks = group.column("code").to_numpy(), group.column("asks").to_numpy(zero_copy_only=False)
        array, own = np.sort(codes[~asks]), codes[asks]
        ids = group.column("class_id").to_numpy()[asks]
        shared = [np.searchsorted(array, (own // w + 1) * w) - np.searchsorted(array, own // w * w) for w in widths[1:]]
        return pa.table({"class_id": np.tile(ids, symbols), "level": np.repeat(np.arange(1, symbols + 1, dtype=np.int32), len(ids)),
                         "shared": np.concatenate(shared).astype(np.int64)})

    columns = ["tree", "first", "part", "code", "class_id", "asks"]
    asked = everywhere(tree_of(queries))
    both = stored().withColumn("asks", F.lit(False)).select(columns).unionByName(asked.withColumn("asks", F.lit(True)).select(columns))
    # the ascent: the longest prefix at which all trees together hold enough
    level = (both.groupBy("tree", "first", "part").applyInArrow(counted, "class_id long, level int, shared long")
             .groupBy("class_id", "level").agg(F.sum("shared").alias("shared")).groupBy("class_id")
             .agg(F.coalesce(F.max(F.when(F.col("shared") >= enough, F.col("level"))), F.lit(0)).alias("level")))
    leveled = settled(queries.select("class_id", "vector", "codes").join(level, "class_id"))
    prefixed = everywhere(tree_of(leveled.where("level > 0"), "vector", "level"))
    # the root of a tree is all of its blocks
    root = (leveled.where("level = 0").select("class_id", "vector", "level", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("code"))
            .join(F.broadcast(splits.where("tree = 0")), "tree")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts"))

    def scored(group: pa.Table) -> pa.Table:
        """Each query's k + 1 best classes among the strings of this block that share its prefix."""
        level = group.column("level").to_numpy()
        asks, codes, vectors = level >= 0, group.column("code").to_numpy(), _matrix(group.column("vector"), dims)
        ids = group.column("class_id").to_numpy()
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.flatnonzero(~asks)[np.lexsort((ids[~asks], codes[~asks]))]
        array = codes[order]
        out: list[tuple] = []
        for shared in np.unique(level[asks]):
            own = np.flatnonzero(level == shared)
            width = widths[shared]
            prefixes = codes[own] // width if shared else np.zeros(len(own), np.int64)
            for prefix in np.unique(prefixes):
                mine = own[prefixes == prefix]
                there = order[np.searchsorted(array, prefix * width):np.searchsorted(array, (prefix + 1) * width)] if shared else order
                for at in range(0, len(mine), 64):
                    some = mine[at:at + 64]
                    scores = (vectors[some] @ vectors[there].T) / (lengths[some][:, None] * lengths[there][None, :])
                    for q, s in zip(some, scores):
                        near = np.arange(len(s))
                        if len(s) > k + 1:
                            near = np.flatnonzero(s >= np.partition(s, -(k + 1))[-(k + 1)])
                        near = near[np.lexsort((ids[there[near]], -s[near]))][:k + 1]
                        out += [(ids[q], ids[there[n]], s[n]) for n in near]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"class_id": pa.array(a, pa.int64()), "near_class": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    columns = ["tree", "first", "part", "code", "class_id", "level", "vector"]
    placed = (stored("vector").withColumn("level", F.lit(-1)).select(columns).unionByName(prefixed.select(columns))
              .unionByName(root.select(columns)))
    best = (placed.groupBy("tree", "first", "part").applyInArrow(scored, "class_id long, near_class long, score double")
            .groupBy("class_id", "near_class").agg(F.max("score").alias("score")))
    # k + 1 ids for each asking class; a query row then leaves itself out
    shown = (best.join(index.select(F.col("class_id").alias("near_class"), "ids"), "near_class")
             .select("class_id", "score", F.explode("ids").alias("near_id")))
    order = Window.partitionBy("class_id").orderBy(F.desc("score"), "near_id")
    lists = (shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
             .groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("place", "near_id", "score"))).alias("near")))
    members = rows.where("asks").select(F.col("id").alias("query_id"), "vector").join(
        queries.select("vector", "class_id"), "vector").select("query_id", "class_id")
    others = F.slice(F.filter("near", lambda n: n["near_id"] != F.col("query_id")), 1, k)
    return (members.join(lists, "class_id").select("query_id", F.posexplode(others).alias("rank", "n"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.near_id").alias(key), "n.score"))
