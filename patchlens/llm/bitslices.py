"""Exact top-k by inner product over a bit-sliced index.

Vector components become integers, floor(``scale`` * x). The rows are dealt into blocks; a block's index holds, for each
dimension, one bitmap for each binary digit of the component's distance from the block's least value: a slice. A query's
scores are the sum of its components times these attributes, made with bitmap arithmetic alone: each non-zero digit of
a component (in signed binary) adds the attribute's slices, shifted, or their complements, and carry-save adders fold all bitmaps of a
weight into one. The k largest rows are then selected from the most significant slice downward; the boundary, rows that agree with
the k-th in every slice, is resolved exactly by the smaller id. Scores are read back from the slices of the selected rows,
and the blocks' winners are ranked once more.

Every query meets every block, a stated query set against all rows: queries travel to the blocks as small rows, the index is
copied once for ``SPAN_QUERIES`` queries. Blocks grow with the table up to ``BLOCK_CELLS`` components, so a task's memory is bounded, and are
smaller on small tables only to use all cores; results do not depend on them.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a component whose integer
leaves 32 bits, or a score that leaves 64, raises; vectors of different lengths are not compared, and one without components
scores 0; candidates with the query's own id are its own row; every other repeated row counts by itself; query rows equal in
id and vector are asked once; ties go to the smaller id; fewer than k candidates are all returned; an empty table gives an empty result;
columns other than the two named are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import settled

#: Components of a block at most, and below which a block is not split further for the sake of idle cores.
BLOCK_CELLS = 1 << 23
LEAST_CELLS = 1 << 16
#: Queries (expected) that one copy of a block's index serves.
SPAN_QUERIES = 16_384

_INDEX = "block int, dims int, ids array<long>, least array<long>, widths array<int>, slices binary"
_FOUND = "number long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): the integer vectors of the rows that take part."""
    e = F.col(vector)
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (vectors.where(F.col(key).isNotNull() & e.isNotNull() & finite)
            .select(F.col(key).cast("long").alias("id"),
                    F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("int")).alias("v")))


def bit_slices(values: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(least value, number of slices) of each column of ``values`` and all slices, lowest digit first, as rows of 64-bit words."""
    rows, words = len(values), -(-len(values) // 64)
    least = values.min(axis=0)
    above = (values - least).astype(np.uint64)
    widths = [int(x).bit_length() for x in above.max(axis=0)]
    out = np.zeros((sum(widths), words * 8), np.uint8)
    at = 0
    for d, width in enumerate(widths):
        for j in range(width):
            out[at, :-(-rows // 8)] = np.packbits((above[:, d] >> np.uint64(j)) & np.uint64(1) != 0, bitorder="little")
            at += 1
    return least, widths, out.view(np.uint64)


def signed_digits(n: int) -> list[tuple[int, int]]:
    """(place, +1 or -1) of n's non-zero digits, no two of them neighbours."""
    out, place = [], 0
    while n:
        if n & 1:
            digit = 2 - (n & 3)
            out.append((place, digit))
            n -= digit
        n >>= 1
        place += 1
    return out


class Block:
    """A block's slices and their complements, ready for queries."""

    def __init__(self, ids: np.ndarray, least: list[int], widths: list[int], slices: bytes):
        self.ids, self.least, self.widths = ids, least, widths
        self.words = -(-len(ids) // 64)
        plain = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        self.bitmaps = np.concatenate([plain, ~plain])
        self.first = np.cumsum([0, *widths]).tolist()
        bits = np.zeros(self.words * 64, np.uint8)
        bits[:len(ids)] = 1
        self.all_rows = np.packbits(bits, bitorder="little").view(np.uint64)

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """(slices, constant): a row's score is its number in the slices plus the constant."""
        constant, at_weight = 0, defaultdict(list)
        for d, q in enumerate(query):
            constant += q * self.least[d]
            for place, digit in signed_digits(q):
                side = 0
                if digit < 0:  # -y is the complement of y less the largest number of that width
                    side = self.first[-1]
                    constant -= ((1 << self.widths[d]) - 1) << place
                for j in range(self.widths[d]):
                    at_weight[place + j].append(side + self.first[d] + j)
        out, carried, weight = [], [], 0
        while at_weight or carried:
            summands = np.concatenate([self.bitmaps[at_weight.pop(weight, [])], *carried])
            carried = []
            while len(summands) > 2:  # full adders: three bitmaps become a sum here and a carry one weight up
                n = len(summands) // 3
                a, b, c = summands[:n], summands[n:2 * n], summands[2 * n:3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                summands = np.concatenate([half ^ c, summands[3 * n:]])
            if len(summands) == 2:
                carried.append(summands[:1] & summands[1:])
                summands = summands[:1] ^ summands[1:]
            out.append(summands[0] if len(summands) else np.zeros(self.words, np.uint64))
            weight += 1
        return out, constant

    def top(self, query_id: int, query: list[int], k: int) -> tuple[np.ndarray, list[int]]:
        """(ids, scores) of the k best candidates of this block, unordered."""
        slices, constant = self.scores(query)
        maybe, sure = self.all_rows.copy(), np.zeros(self.words, np.uint64)
        own = np.arange(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right"))
        np.bitwise_and.at(maybe, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        left = k
        for s in reversed(slices):
            ones = maybe & s
            n = int(np.bitwise_count(ones).sum())
            if n > left:
                maybe = ones
            else:
                sure |= ones
                maybe = maybe & ~s
                left -= n
                if not left:
                    break
        chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if left:  # rows of the boundary are equal in score; rows are in order of their ids
            edge = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))[:left]
            chosen = np.concatenate([chosen, edge])
        scores = [constant] * len(chosen)
        for weight, s in enumerate(slices):
            ones = (s[chosen // 64] >> (chosen % 64).astype(np.uint64)) & np.uint64(1)
            scores = [score + (int(x) << weight) for score, x in zip(scores, ones)]
        return self.ids[chosen], scores


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column."""
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), bounds


def index(rows: DataFrame, blocks: int) -> DataFrame:
    """The bit-sliced index of (id, v): a row for each block and vector length, its rows in order of their ids."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, block = defaultdict(list), defaultdict(list), None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0)[0].as_py()
            flat, bounds = _lists(batch.column(2))
            keys, lengths = batch.column(1).to_numpy(), np.diff(bounds)
            for n in np.unique(lengths).tolist():
                which = np.flatnonzero(lengths == n)
                ids[n].append(keys[which])
                values[n].append(flat[bounds[which][:, None] + np.arange(n)].reshape(len(which), n).astype(np.int64))
        for n, parts in ids.items():
            keys, matrix = np.concatenate(parts), np.concatenate(values.pop(n))
            order = np.argsort(keys, kind="stable")
            least, widths, slices = bit_slices(matrix[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([n], pa.int32()), pa.array([keys[order]], pa.list_(pa.int64())),
                 pa.array([least.tolist()], pa.list_(pa.int64())), pa.array([widths], pa.list_(pa.int32())), pa.array([slices.tobytes()], pa.binary())],
                names=["block", "dims", "ids", "least", "widths", "slices"])

    return rows.repartition(blocks).select(F.spark_partition_id().alias("block"), "id", "v").mapInArrow(build, _INDEX)


def search(vectors: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
           block_cells: int = BLOCK_CELLS, span_queries: int = SPAN_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row whose id meets ``asked``, a condition on the column ``id``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector, scale)
    cells = rows.agg(F.sum(F.greatest(F.size("v"), F.lit(1))).alias("n")).first()["n"] or 0
    wide = min(spark.sparkContext.defaultParallelism, -(-cells // LEAST_CELLS))
    blocks = max(1, -(-cells // block_cells), wide)
    queries = settled(rows.where(asked).distinct().select(F.monotonically_increasing_id().alias("number"), F.col("id").alias("query_id"), "v"))
    spans = max(1, -(-queries.count() // span_queries))

    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    sent = queries.select("number", "query_id", "v", F.size("v").alias("dims"),
                          F.pmod(F.xxhash64("number"), F.lit(spans)).cast("int").alias("span"), each_block)
    built = index(rows, blocks).select("*", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"))

    def answer(held: pa.Table, wanted: pa.Table) -> pa.Table:
        numbers, query_ids, found, scores = [], [], [], []
        if held.num_rows and wanted.num_rows:
            row = held.slice(0, 1).to_pylist()[0]
            block = Block(np.array(row["ids"], np.int64), row["least"], row["widths"], row["slices"])
            for number, query_id, v in zip(*(wanted.column(c).to_pylist() for c in ("number", "query_id", "v"))):
                ids, points = block.top(query_id, v, k)
                numbers += [number] * len(ids)
                query_ids += [query_id] * len(ids)
                found += ids.tolist()
                scores += points
        return pa.table([pa.array(c, pa.int64()) for c in (numbers, query_ids, found, scores)], names=["number", "query_id", "vec_id", "score"])

    place = ("block", "dims", "span")
    # a number of its own: the shuffles are small and the work after them is not, so adaptive execution must not merge them
    tasks = 2 * blocks * spans
    found = (built.repartition(tasks, *place).groupBy(*place).cogroup(sent.repartition(tasks, *place).groupBy(*place))
             .applyInArrow(answer, _FOUND))
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
