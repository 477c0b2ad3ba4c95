"""One-permutation MinHash fingerprints of word shingles.

Every shingle is hashed once; the hash's high part picks one of ``BINS`` bins, which keeps its smallest low
part. An empty bin takes the value of the first non-empty bin in its own fixed random order of all bins
(optimal densification: each empty bin draws independently, the same way for every text). ``BITS`` bits of each bin's value,
rehashed with the bin so that chance agreements are independent, are packed as the fingerprint.
Two fingerprints' share of equal bins E gives the likeness (E - 2**-BITS) / (1 - 2**-BITS): equal low
bits by chance are taken off.

Edge cases: a text with fewer words than a shingle is one shingle; a null or wordless text has the empty fingerprint,
of likeness 1 to another empty one and 0 to all else; case and white space do not matter; equal texts have equal fingerprints; long
texts are hashed block by block. For neighbours, rows go by key, null keys first, rows of one key by a hash of their
text; every row counts, the last one's next is the first; a table of one row is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import arrow_rows, settled, small_batches

SHINGLE = 5
BINS = 512
BITS = 4
#: Words hashed at a time, and words whose hashes a worker keeps; emptied when full.
BLOCK_WORDS = 1 << 16
CACHE_WORDS = 500_000

#: Each empty bin's order of the bins it borrows from, as places: ``_PLACE[bin, other]``.
_PLACE = np.argsort(np.random.default_rng(2017).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BIN_SALT = np.arange(1, BINS + 1, dtype=np.uint64) * _ODD


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


_HASHES = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word (the 64-bit finaliser of SplitMix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None) -> bytes:
    words = text.lower().split() if text else []
    if not words:
        return b""
    least, bin_bits = np.full(BINS, _NONE), np.uint64(BINS.bit_length() - 1)
    width = min(SHINGLE, len(words))
    for at in range(0, len(words) - width + 1, BLOCK_WORDS):
        part = words[at:at + BLOCK_WORDS + width - 1]
        h = np.fromiter(map(_HASHES.__getitem__, part), np.uint64, len(part))
        n = len(part) - width + 1
        mix = h[:n]
        for k in range(1, width):
            mix = mix * _ODD + h[k:k + n]
        mix = _mixed(mix)
        np.minimum.at(least, (mix >> (np.uint64(64) - bin_bits)).astype(np.int64), mix << bin_bits)
    return packed(densified(least))


def densified(least: np.ndarray) -> np.ndarray:
    empty = least == _NONE
    if empty.any():
        filled = np.flatnonzero(~empty)
        least[empty] = least[filled[_PLACE[empty][:, filled].argmin(axis=1)]]
    return least


def packed(least: np.ndarray) -> bytes:
    """``BITS`` (4) bits of each bin, two bins a byte."""
    bits = (_mixed(least + _BIN_SALT) >> np.uint64(64 - BITS)).astype(np.uint8)
    return (bits[0::2] << 4 | bits[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    equal = (np.count_nonzero((x ^ y) >> 4 == 0) + np.count_nonzero((x ^ y) & 15 == 0)) / BINS
    by_chance = 2.0 ** -BITS
    return max(0.0, (equal - by_chance) / (1 - by_chance))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) for every row."""
    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"id": batch["id"], "fingerprint": [fingerprint(t) for t in batch["text"]]}

    kind = docs.schema[key].dataType.simpleString()
    return (arrow_rows(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {kind}, fingerprint binary")
            .withColumnRenamed("id", key))


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters of the following one."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


_MARKED = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("text", pa.binary()), ("fingerprint", pa.binary())])
_RESULT = [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
           ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_STREAMED = pa.schema([("bucket", pa.int32()), ("role", pa.string()), *_RESULT, ("text", pa.binary())])
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _compared(row: tuple, following: tuple) -> tuple:
    """The result columns of a row (id, packed text, fingerprint) and the one after it."""
    text, other = (zstandard.decompress(r[1]).decode("utf-8", "surrogatepass") for r in (row, following))
    changed = edited(text, other)
    again = fingerprint(changed)
    return (row[0], len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), row[2], again,
            likeness(row[2], again), likeness(row[2], following[2]))


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every row against
    its edited text and against the next row by ``key`` (a long).

    Rows go once through a range shuffle on the key, as fingerprint and compressed text. Within a range each row meets
    the next; the first and last rows of the ranges, one of each a range, meet in a small join."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bucket = [0 if i is None else int(np.searchsorted(cuts, i, "right")) for i in ids]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                bucket, ids, [xxhash.xxh64_intdigest(r) >> 1 for r in raw], [packer.compress(r) for r in raw],
                [fingerprint(t) for t in texts]), _MARKED)], schema=_MARKED)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bucket, blank = None, None, (None,) * len(_RESULT)
        for batch in batches:
            out = []
            for b, i, body, mark in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "text", "fingerprint"))):
                row = (i, body, mark)
                if b != bucket:
                    if before is not None:
                        out.append((bucket, "last", before[0], *blank[1:3], before[2], *blank[4:], before[1]))
                    out.append((b, "first", i, *blank[1:3], mark, *blank[4:], body))
                    bucket = b
                else:
                    out.append((b, "done", *_compared(before, row), None))
                before = row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _STREAMED)] if out else
                                             [pa.array([], f.type) for f in _STREAMED], schema=_STREAMED)
        if before is not None:
            last = (bucket, "last", before[0], *blank[1:3], before[2], *blank[4:], before[1])
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(last, _STREAMED)], schema=_STREAMED)

    small_batches(spark)
    met = settled(rows.mapInArrow(marked, _ddl(_MARKED)).repartitionById(ranges, F.col("bucket"))
                  .sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "tie").mapInArrow(streamed, _ddl(_STREAMED)))
    names = [n for n, _ in _RESULT]
    ends = met.select("bucket", "role", "id", "fingerprint", "text")
    present = sorted(r["bucket"] for r in ends.where("role = 'first'").select("bucket").collect())  # one a range
    following = spark.createDataFrame(list(zip(present, present[1:] + present[:1])), "bucket int, next_bucket int")
    firsts = ends.where("role = 'first'").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("other_text"),
                                                 F.col("fingerprint").alias("other_fingerprint"))
    seams = ends.where("role = 'last'").join(following, "bucket").join(firsts, "next_bucket")

    def closed(batch: dict[str, list]) -> dict[str, list]:
        got = [_compared((i, t, f), (None, u, g)) for i, t, f, u, g in zip(*(batch[c] for c in (
            "id", "text", "fingerprint", "other_text", "other_fingerprint")))]
        return dict(zip(names, zip(*got))) if got else {n: [] for n in names}

    rest = arrow_rows(seams.select("id", "text", "fingerprint", "other_text", "other_fingerprint"), closed, _ddl(pa.schema(_RESULT)))
    return met.where("role = 'done'").select(*names).unionByName(rest).withColumnRenamed("id", key)
