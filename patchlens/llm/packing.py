"""Tokens, pieces and best-fit packing with a swap-based local search.

Documents become token ids; only those longer than a sequence are cut. Pieces as long as a sequence stand
alone. All others are dealt at random into groups of about ``GROUP_PIECES`` pieces; each group is packed by best
fit, then improved by local search: moves, one-for-one and two-for-one exchanges that take tokens out of an emptier sequence
into the gaps of fuller ones, each raising the sum of squared fills, until sequences empty or no exchange is left.
What lies in sequences with more than ``DISSOLVE`` of their room free is packed again with the other groups' leftovers, level by level, so the whole
table ends with a few open sequences rather than a few for each group. A level that leaves as many sequences as it was given is the last,
and one that leaves more is dropped for the one before: some lengths fill no sequence.

Edge cases: a null or empty text is a document of just the end id; special tokens' strings in a text are the tokenizer's
to judge; equal rows are packed one by one; a null key is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import settled, small_batches

GROUP_PIECES = 4096
#: Free share of a sequence from which its pieces are packed again at the next level.
DISSOLVE = 0.01
#: White-space separated strings whose ids a worker process keeps in each of two generations: a full one becomes the older, and strings
#: that are still in use come over from it.
CACHE_STRINGS = 500_000
#: Outside white space these separate for Python but not for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
#: Letters, then marks that the tokenizer splits from letters: the two parts have ids of their own.
_STEM = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class Ids(dict):
    """A white-space separated string to its ids, packed little-endian. The tokenizer drops white space and never merges across it, so a text's ids are
    its strings' ids in a row."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.pieces_of = self.tokenizer.model.tokenize
        # how the tokenizer spells a lower-case letter for its merges
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {ord(c): spell(c)[0][0] for c in map(chr, range(0x100)) if _STEM.fullmatch(c) and c == c.lower()}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_STRINGS:
            self.older = dict(self)
            self.clear()
        if (got := self.older.get(word)) is not None:
            self[word] = got
            return got
        parts = _STEM.fullmatch(word)
        if not parts:
            got = self.encode(word)
        elif parts[2] or (stem := parts[1].lower()) != word:
            got = self[parts[1].lower()] + (self[parts[2]] if parts[2] else b"")
        else:  # a run of lower-case letters is one unit to the tokenizer: merged without normalising it again
            got = np.array([p.id for p in self.pieces_of(stem.translate(self.spelling))], "<u4").tobytes()
        self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or _ODD.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


#: Tokenizer path to the worker process's store of ids.
_STORES: dict[str, Ids] = {}


def ids_of(tokenizer_path: str) -> Ids:
    if tokenizer_path not in _STORES:
        _STORES[tokenizer_path] = Ids(tokenizer_path)
    return _STORES[tokenizer_path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids): ids as little-endian unsigned 32-bit numbers, the end id after each document."""
    step, end = 4 * capacity, np.array([end_id], "<u4").tobytes()
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ids_of(tokenizer_path)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.of(t) + end
                rows += [(k, at // step, at // 4, min(step, len(ids) - at) // 4, ids[at:at + step]) for at in range(0, len(ids), step)]
            columns = list(zip(*rows)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "piece", "start", "length", "ids"])

    small_batches(docs.sparkSession)
    return (docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
            .mapInArrow(run, f"id {kind.simpleString()}, piece int, start long, length long, ids binary").withColumnRenamed("id", key))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, into the fullest bin that has room."""
    where, room, bins = np.empty(len(sizes), np.int64), [], 0
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, bins
            bins += 1
        where[item] = b
        if free > size:
            insort(room, (free - size, b))
    return where


def local_search(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Empties the least full bins into the gaps of the others. An exchange moves ``d`` tokens from bin x to
    bin y; it raises the sum of squared fills when y is at least as full as x loses, that is when
    fill(y) + d > fill(x)."""
    where = where.copy()
    fill = np.bincount(where, sizes, minlength=where.max() + 1).astype(np.int64) if len(where) else np.zeros(0, np.int64)
    least, moved = -(-int(sizes.sum()) // capacity), True
    while moved:  # passes over the open bins, least full first, until one changes nothing
        moved = False
        for x in sorted(np.flatnonzero((fill > 0) & (fill < capacity)), key=lambda b: (fill[b], b)):
            while 0 < fill[x] < capacity and (fill > 0).sum() > least and _exchange(sizes, where, fill, x, capacity):
                moved = True
    return np.unique(where, return_inverse=True)[1]


def _exchange(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, x: int, capacity: int) -> bool:
    """The exchange that takes most tokens out of bin ``x``; False if none raises the squared fill."""
    own = np.flatnonzero(where == x)
    gap = np.where(fill > 0, capacity - fill, -1)
    gap[x] = -1
    others = np.flatnonzero(gap[where] > 0)
    if not len(others):
        return False
    room, there = gap[where[others]], sizes[others]
    most, plan = 0, None
    pairs = [(i, j) for k, i in enumerate(own) for j in own[k + 1:]]
    for taken in [(i,) for i in own] + pairs:
        size = int(sizes[list(taken)].sum())
        if len(taken) == 1 and size > most:  # move: nothing comes back
            fits = np.flatnonzero(gap >= size)
            if len(fits):
                y = fits[np.argmin(gap[fits])]
                if fill[y] + size > fill[x]:
                    most, plan = size, (taken, None, y)
        if size <= most:
            continue
        d = size - there
        good = (d > most) & (d <= room) & (fill[where[others]] + d > fill[x])
        if good.any():
            at = int(np.argmax(np.where(good, d, -1)))
            most, plan = int(d[at]), (taken, others[at], where[others[at]])
    if plan is None:
        return False
    taken, back, y = plan
    where[list(taken)] = y
    if back is not None:
        where[back] = x
    fill[x] -= most
    fill[y] += most
    return True


def pack(rows: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``rows`` (with ``length``) and the ``sequence_id`` and ``offset`` of each. Rows should be narrow and settled: their places
    are computed level by level, each level written to the shared folder."""
    rows = settled(rows.withColumn("row_number", F.monotonically_increasing_id()))
    full = F.col("length") >= capacity
    done = [rows.where(full).withColumn("sequence_id", F.col("row_number") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))]
    left, level, base = rows.where(~full), 0, 0
    count, before, given = left.count(), None, None
    fields = [*rows.columns, "sequence_id", "offset", "fill"]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["sequence_id long", "offset long", "fill long"])
    while True:
        groups = max(1, -(-count // group_pieces))

        def packed(group: pa.Table) -> pa.Table:
            group = group.sort_by([("length", "descending"), ("row_number", "ascending")])
            sizes = group.column("length").to_numpy()
            where = local_search(sizes, best_fit(sizes, capacity), capacity)
            order = np.argsort(where, kind="stable")
            ends = np.cumsum(sizes[order])
            starts, bins = ends - sizes[order], where[order]
            first = np.r_[True, bins[1:] != bins[:-1]]
            offset = np.empty(len(sizes), np.int64)
            offset[order] = starts - starts[first][np.cumsum(first) - 1]
            number = base + (int(group.column("group")[0].as_py()) << 24) + where
            fill = np.bincount(where, sizes).astype(np.int64)[where]
            return (group.drop_columns(["group"]).append_column("sequence_id", pa.array(number, pa.int64()))
                    .append_column("offset", pa.array(offset, pa.int64())).append_column("fill", pa.array(fill, pa.int64())).select(fields))

        placed = settled(left.withColumn("group", F.pmod(F.xxhash64("row_number", F.lit(level)), F.lit(groups)))
                         .groupBy("group").applyInArrow(packed, kinds))
        again = F.col("fill") < capacity * (1 - DISSOLVE)
        seen = placed.agg(F.count_distinct("sequence_id").alias("made"), F.count_distinct(F.when(again, F.col("sequence_id"))).alias("open"),
                          F.count_if(again).alias("pieces")).first()
        if given is not None and seen["made"] > given:  # worse than the level before
            done.append(before)
            break
        if groups == 1 or seen["made"] == given:
            done.append(placed)
            break
        done.append(placed.where(~again))
        before, given, count = placed.where(again), seen["open"], seen["pieces"]
        left, level, base = before.select(*rows.columns), level + 1, base + (groups << 24)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d.drop("fill"))
    return out.drop("row_number")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): the pieces of all documents, packed. The ids themselves are
    ``pieces``'; only their checksum travels through the packing."""
    cut = pieces(docs, tokenizer_path, capacity, end_id, key, text)
    return (pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)
            .select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
