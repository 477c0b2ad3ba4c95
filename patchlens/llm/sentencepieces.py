"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into segments that no piece crosses. The distinct segments' substrings, no longer than the longest piece, are
exploded and equi-joined to the piece table; the hits are the edges of each segment's lattice, grouped by segment and
folded from left to right.

The public vocabulary is a byte-pair model, whose own encoding is no largest sum of scores (such a Viterbi fold differs from it
on most words). So the fold's survivor at each position is not the best-scored edge but the only valid one: merges make
exactly one last piece for every prefix, namely the edge that no earlier merge across its left end would have broken up. An edge
t after the survivor a at its left end is broken up if a lattice edge c crosses that end, starts at a part of a's right
side and ends at a part of t's left side that are both still whole when c's merge has its turn. ``right`` and ``left``
give, for each piece and each length of such a part, the rank of the merge that swallows it.

Whether t may follow a thus depends on the two pieces alone, so a task remembers it for pairs seen (``PAIRS`` of them). That is why the
fold runs over Arrow batches of lattices: a higher-order aggregate has no such memory and takes over 200 microseconds a segment.

The vocabulary of all texts, with the blocks of documents each segment is in, is written to the shared folder. Segments of the most blocks
are broadcast with their ids, ``FREQUENT`` at most; every other one is looked up by block, so a task holds one block's texts and dictionary.

Edge cases: a null or empty text has no ids; spaces and a leading one are the piece mark; characters outside the
vocabulary become their UTF-8 bytes' pieces; ids outside the vocabulary decode to nothing; rows with a null or repeated key are encoded
one by one; only the key and the text are read, whatever other columns are named; an unbroken run of letters, however long, is one
segment, whose lattice a task holds as a row of at most ``Pieces.longest`` numbers a character; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from patchlens.llm.common import small_batches
from patchlens.session import ensure_checkpoint_dir

MARK = "▁"
#: Most segments that are broadcast with their ids.
FREQUENT = 200_000
#: Text bytes of a block of documents; words and segments that a task holds before it passes them on.
BLOCK_BYTES = 16 << 20
HELD_WORDS, HELD_SEGMENTS = 800_000, 250_000
#: Blocks in one row of the segment table; segments that a task makes lattices of; remembered pairs of pieces.
BLOCKS_A_ROW = 1000
SEGMENTS_A_TASK = 20_000
PAIRS = 1_000_000
#: Segments of one batch that a task passes on.
PACKED_SEGMENTS = 20_000
_NEVER = 1_000_000

_LETTERS = regex.compile(f"{MARK}*\\p{{L}}+|{MARK}*[^\\p{{L}}{MARK}]+|{MARK}+")
_WORDS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _parts(piece: str, rank: dict[str, int]) -> tuple[list[int], list[int]] | None:
    """(right, left): for each length from 0, the rank of the merge that swallows the part of that length at the piece's right
    and left end while the piece is built; ``_NEVER`` for the whole, -1 where no such part is ever whole. None if
    merges do not end in the piece."""
    nodes: list = list(piece)
    text = lambda n: n if isinstance(n, str) else n[0]
    while len(nodes) > 1:
        found = [(rank[s], k) for k in range(len(nodes) - 1) if (s := text(nodes[k]) + text(nodes[k + 1])) in rank]
        if not found:
            return None
        _, k = min(found)
        nodes[k:k + 2] = [(text(nodes[k]) + text(nodes[k + 1]), nodes[k], nodes[k + 1])]
    sides = []
    for side in (2, 1):
        limits, node, limit = [-1] * (len(piece) + 1), nodes[0], _NEVER
        while True:
            limits[len(text(node))] = limit
            if isinstance(node, str):
                break
            limit, node = rank[node[0]], node[side]
        sides.append(limits)
    return sides[0], sides[1]


@dataclass(frozen=True)
class Pieces:
    """A model's vocabulary; its size is fixed."""

    path: str

    @cached_property
    def _model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def names(self) -> list[str]:
        return [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]

    @cached_property
    def first_byte(self) -> int:
        return self._model.piece_to_id("<0x00>")

    @cached_property
    def parts(self) -> dict[int, tuple[int, list[int], list[int]]]:
        """Id to (rank, right, left) of every piece that merges can make."""
        m = self._model
        plain = {i: p for i, p in enumerate(self.names) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
        order = {x: k for k, x in enumerate(sorted({-m.get_score(i) for i in plain}))}
        rank = {p: order[-m.get_score(i)] for i, p in plain.items() if len(p) > 1}
        return {i: (rank.get(p, 0), *sides) for i, p in plain.items() if (sides := _parts(p, rank)) is not None}

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Rank of every piece that a merge makes."""
        return {self.names[i]: p[0] for i, p in self.parts.items() if len(self.names[i]) > 1}

    @cached_property
    def characters(self) -> set[str]:
        return {self.names[i] for i in self.parts if len(self.names[i]) == 1}

    def follows(self, a: int, t: int) -> bool:
        """Whether no earlier merge crosses the border of piece ``a`` and piece ``t`` after it."""
        before, after, right, left = self.names[a], self.names[t], self.parts[a][1], self.parts[t][2]
        for i in range(1, len(before) + 1):
            if right[i] < 0:
                continue
            for j in range(1, min(len(after), self.longest - i) + 1):
                rank = self.ranks.get(before[-i:] + after[:j])
                if rank is not None and rank < right[i] and rank <= left[j]:
                    return False
        return True

    @cached_property
    def longest(self) -> int:
        return max(len(self.names[i]) for i in self.parts)

    @cached_property
    def cut(self) -> regex.Pattern:
        """Runs of letters and of other characters, where no piece holds both; else what lies between marks."""
        return _LETTERS if all(_LETTERS.fullmatch(self.names[i]) for i in self.parts) else _WORDS


def segments_of(text: str | None, cut: regex.Pattern) -> list[str]:
    return cut.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_segments(words: DataFrame, pieces: Pieces, keep: list[str]) -> DataFrame:
    """``words`` (``segment`` and the columns ``keep``; rows without repeats, dealt by segment) with each segment's ``ids``, packed as 32-bit
    numbers. A segment that holds no piece at all is left out: see ``spelled``."""
    longest = pieces.longest
    if longest > 127 or len(pieces.names) >= 1 << 25:
        raise ValueError("pieces of more than 127 characters, or 2^25 pieces and more")
    table = words.sparkSession.createDataFrame([(pieces.names[i], i) for i in pieces.parts], "piece string, id int")
    # an edge is one number: end, 127 less its length, id; in order, longer ones of an end come first
    edges = (words.select("segment", *keep, F.explode(F.expr("sequence(1, length(segment))")).alias("f"))
             .select("segment", *keep, "f", F.explode(F.expr(f"sequence(1, least(f, {longest}))")).alias("l"))
             .withColumn("piece", F.expr("substring(segment, f - l + 1, l)")).join(F.broadcast(table), "piece")
             .select("segment", *keep, F.expr("shiftleft(bigint(f), 32) + shiftleft(bigint(127 - l), 25) + id").alias("edge")))
    lattice = edges.groupBy("segment", *keep).agg(F.sort_array(F.collect_list("edge")).alias("edges")).select(*keep, "segment", "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bool] = {}
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends, lengths, ids = (flat >> 32).tolist(), (127 - ((flat >> 25) & 127)).tolist(), (flat & ((1 << 25) - 1)).tolist()
            at, out = [0, *np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()], []
            for k, segment in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                here = slice(at[k], at[k + 1])
                out.append(_fold(segment, ends[here], lengths[here], ids[here], pieces, known))
                if len(known) > PAIRS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "ids"])

    return lattice.mapInArrow(run, StructType([*lattice.schema.fields[:-1], StructField("ids", BinaryType())]))


def _fold(segment: str, ends: list[int], lengths: list[int], ids: list[int], pieces: Pieces, known: dict[int, bool]) -> bytes:
    """For each position the survivor that ends there, then the path back from the last one."""
    picks, reach = [-1] * (len(segment) + 1), [1] * (len(segment) + 1)
    for f, l, t in zip(ends, lengths, ids):
        if picks[f] >= 0:
            continue
        if l < f and (a := picks[f - l]) >= 0:
            pair = a << 25 | t
            valid = known.get(pair)
            if valid is None:
                valid = known[pair] = pieces.follows(a, t)
            if not valid:
                continue
        picks[f], reach[f] = t, l
    path: list[int] = []
    f = len(segment)
    while f:
        path += [picks[f]] if picks[f] >= 0 else reversed(_bytes_of(segment[f - 1], pieces))
        f -= reach[f]
    path.reverse()
    return array("i", path).tobytes()


def _bytes_of(character: str, pieces: Pieces) -> list[int]:
    if character in pieces.characters:
        raise ValueError(f"no valid pieces up to {character!r}")
    return [b + pieces.first_byte for b in character.encode("utf-8", "replace")]


def spelled(segment: str, pieces: Pieces) -> bytes:
    """The ids of a segment without any piece: its characters' bytes."""
    return array("i", [i for c in segment for i in _bytes_of(c, pieces)]).tobytes()


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` and the ``text`` of their arrays of ids: the pieces' bytes in a row, marks as spaces, without the first one; null for null."""
    small_batches(rows.sparkSession)
    pieces = Pieces(model_path)
    m = pieces._model
    raw = {i: bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode()
           for i, p in enumerate(pieces.names) if not (m.is_control(i) or m.is_unknown(i))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            flat, ends, texts = column.values.to_pylist(), column.offsets.to_pylist(), []
            for k, there in enumerate(column.is_valid().to_pylist()):
                whole = b"".join([raw.get(i, b"") for i in flat[ends[k]:ends[k + 1]]])
                texts.append((whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace") if there else None)
            yield batch.append_column(text, pa.array(texts, pa.string()))

    return rows.mapInArrow(run, StructType([*rows.schema, StructField(text, StringType())]))


def _vocabulary(rows: DataFrame, cut: regex.Pattern) -> DataFrame:
    """(segment, range, blocks) of all segments: a row for each ``BLOCKS_A_ROW`` blocks, with those that hold the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}
        held: dict[str, list[int]] = {}
        parts: dict[str, list[str]] = {}
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                there = seen.setdefault(block, set())
                fresh = set(_words(text)) - there
                there |= fresh
                for w in fresh:
                    found = parts.get(w)
                    if found is None:
                        found = parts[w] = segments_of(w, cut)
                    for s in found:
                        got = held.get(s)
                        if got is None:
                            held[s] = [block]
                        elif got[-1] != block:
                            got.append(block)
            if len(held) > HELD_SEGMENTS or sum(map(len, seen.values())) > HELD_WORDS:
                yield from packed(held)
                seen, held, parts = {}, {}, {}
        yield from packed(held)

    def packed(held: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        entries = iter(held.items())
        while some := list(islice(entries, PACKED_SEGMENTS)):
            yield one(some)

    def one(some: list[tuple[str, list[int]]]) -> pa.RecordBatch:
        found = [(s, g, sorted({b for b in blocks if b // BLOCKS_A_ROW == g})) for s, blocks in some for g in {b // BLOCKS_A_ROW for b in blocks}]
        s, g, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(g, pa.int32()), pa.array(b, pa.list_(pa.int32()))],
                                          names=["segment", "range", "blocks"])

    return (rows.select("block", "text").mapInArrow(run, "segment string, range int, blocks array<int>")
            .groupBy("segment", "range").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks")))


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, ids) for every row."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    pieces = Pieces(model_path)
    cut = pieces.cut
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.substring("text", 1, 64)), F.lit(blocks)).cast("int"))

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/segments-{uuid4().hex}"
    _vocabulary(rows, cut).write.parquet(path, compression="zstd")
    vocabulary = spark.read.parquet(path)
    spread = vocabulary.groupBy(F.size("blocks").alias("n")).count().orderBy(F.desc("n")).collect()  # BLOCKS_A_ROW rows at most
    bar, above = BLOCKS_A_ROW + 1, 0
    for n, count in spread:
        above += count
        if above > frequent:
            break
        bar = n
    tasks = max(1, -(-sum(r["count"] for r in spread) // SEGMENTS_A_TASK))
    top = vocabulary.where(F.size("blocks") >= bar).select("segment").distinct().repartition(max(1, -(-frequent // SEGMENTS_A_TASK)), "segment")
    got = encode_segments(top, pieces, []).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(got.column("segment").to_pylist(), got.column("ids").to_pylist())))
    rest = vocabulary.where(F.size("blocks") < bar).repartition(tasks, "segment")
    coded = encode_segments(rest, pieces, ["range", "blocks"]).select(F.explode("blocks").alias("block"), "segment", "ids")

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=4)
        for batch in batches:
            body = [None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary()), batch.column(2)], names=["id", "body", "block"])

    def assembled(texts: pa.Table, found: pa.Table) -> pa.Table:
        often = known.value
        segments = dict(zip(found.column("segment").to_pylist(), found.column("ids").to_pylist()))
        coded_words: dict[str, bytes] = {}

        def ids_of(s: str) -> bytes:
            got = often.get(s)
            if got is None:
                got = segments.get(s)
            return spelled(s, pieces) if got is None else got

        values, ends = [], [0]
        for body in texts.column("body").to_pylist():
            words = _words(zstandard.decompress(body).decode("utf-8", "surrogatepass") if body else None)
            for w in {w for w in words if w not in coded_words}:
                coded_words[w] = b"".join(map(ids_of, segments_of(w, cut)))
            values.append(b"".join(map(coded_words.__getitem__, words)))
            ends.append(ends[-1] + len(values[-1]) // 4)
        flat = pa.array(np.frombuffer(b"".join(values), np.int32))
        return pa.table({"id": texts.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)})

    bodies = rows.select("id", "text", "block").mapInArrow(squeezed, f"id {kind}, body binary, block int")
    # a count of its own on both sides: by their small size blocks would be put together in a few tasks
    bodies, coded = bodies.repartition(blocks, "block"), coded.repartition(blocks, "block")
    return (bodies.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assembled, f"id {kind}, ids array<int>")
            .withColumnRenamed("id", key))


def _words(text: str | None) -> list[str]:
    """The text in parts at whose borders segments end too: the words between single spaces. Where spaces meet or stand at an end, or the text
    has a mark of its own, the whole text is one part."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [text]
    return text.split(" ")
