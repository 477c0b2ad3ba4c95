"""Collocations: frequent phrases of two and three words by how strongly their parts hold together.

Texts are lower-cased (A to Z), split at ``BREAKS`` into pieces and these at spaces and tabs into words; phrases lie within a piece.
Everything is counted for each language.

Counting is by Rabin-Karp fingerprints. A task lays the words of many texts in a row and hashes every n-gram with numpy: the prefix
polynomial P[i] = sum of hash(word j) * BASE^j modulo 2^64 gives an n-gram's fingerprint as (P[i + n] - P[i]) / BASE^i; language and
n are mixed in. It sorts the fingerprints, tells apart different phrases of one fingerprint by their words, and passes on one
entry for each: fingerprint, count, and a pointer to an occurrence. Entries are shuffled by ranges of fingerprints in packed
blocks and added up there; only fingerprints counted ``least`` times in all go on. One and two words are counted first: three words are as frequent
as that only if both their pairs are, so the frequent pairs' fingerprints, in a bit filter of ``FILTER_BITS``, spare the second pass
most of the rest (a false hit costs an entry, a miss cannot be). The pointers, one for each task's share, are
then followed: they meet the texts by the texts' hash, and every share is read from its text. So counts are summed over
real phrases and a collision between tasks comes apart; only frequent phrases are ever spelled out. Phrases that fall below ``least`` once collisions
are gone are dropped.

What a task holds is bounded: ``FLUSH_WORDS`` words (or one longer text), ``BUCKET_ENTRIES`` entries, ``BLOCK_BYTES`` of texts, all in expectation over
hashes. A hot word or phrase arrives as one entry for each flush, and equal texts are sent once for each task.

Edge cases: a null or empty text has no words; a null language is ``und``; repeated rows count each; an empty table, or one without a
frequent phrase, gives an empty result; ties go by count, then phrase in byte order; texts of any length are counted whole; columns other than the two
named are never read, so names cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import settled, small_batches

# Where pieces end, and the scores' unit.
BREAKS = b".,;:!?\n\x0b\x0c\r"
MILLION = 1_000_000
LONGEST = 3
UNKNOWN = "und"
#: Bits of a fingerprint that are kept: fewer make smaller entries and more collisions, which cost a look at the text and no more.
PRINT_BITS = 48
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
#: Bounds of what a task holds at once: words hashed, entries added up, bytes of texts looked into.
FLUSH_WORDS = 1 << 21
BUCKET_ENTRIES = 1 << 22
BLOCK_BYTES = 32 << 20
#: Bits of the filter of frequent pairs, a power of two whatever the input, and the parts it is put together from.
FILTER_BITS = 1 << 27
FILTER_PARTS = 64
#: Parts of a language's phrases that are ranked by themselves before the best are ranked together.
RANK_PARTS = 64

_MASK = (1 << 64) - 1
_CLEAN = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
_STOP = b"\xff"  # no byte of UTF-8


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, ``_STOP`` between pieces."""
    return text.lower().translate(_CLEAN).replace(b"\n", b" \xff ").split()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _salt(lang: str, n: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), n)


def fingerprint(lang: str, words: list[bytes]) -> int:
    """The fingerprint of one phrase; its lowest two bits say how many words."""
    total = sum(xxhash.xxh64_intdigest(w) * pow(BASE, k, 1 << 64) for k, w in enumerate(words))
    return ((total + _salt(lang, len(words))) & _MASK) >> (64 - PRINT_BITS) & ~3 | len(words)


def text_hash(lang: str, text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, xxhash.xxh32_intdigest(lang.encode()))


class Numbers(dict):
    """A word to its number, in order of appearance; ``hashes`` has the words' hashes by number. Number 0 stands between pieces and texts."""

    def __init__(self):
        super().__init__({_STOP: 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return got


class Filter:
    """Fingerprints seen, two bits each; ``bits`` is a bit array as bytes, its length a power of two."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(prints: np.ndarray, size: int) -> np.ndarray:
        width = (size - 1).bit_length()
        return np.concatenate([prints >> np.uint64(2) & np.uint64(size - 1), (prints * np.uint64(BASE)) >> np.uint64(64 - width)])

    def holds(self, prints: np.ndarray) -> np.ndarray:
        at = self.places(prints, len(self.bits) * 8)
        one = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return (one[:len(prints)] & one[len(prints):]).astype(bool)


@dataclass
class Held:
    """The words of many texts in a row, until they are counted."""

    numbers: Numbers = field(default_factory=Numbers)
    parts: list[np.ndarray] = field(default_factory=list)
    texts: list[tuple[int, str, int]] = field(default_factory=list)  # hash, language, place of the first word
    size: int = 0

    def add(self, lang: str, text: bytes) -> None:
        words = tokens(text)
        self.texts.append((text_hash(lang, text), lang, self.size))
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.parts.append(np.zeros(1, np.uint32))
        self.size += len(words) + 1

    def counted(self, orders: tuple[int, ...] = (1, 2, 3), pairs: Filter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """(fingerprints in order, place of an occurrence of each, count of each, words of each language) for phrases of ``orders`` words; of three
        words only those whose pairs the filter holds."""
        words = np.concatenate(self.parts)
        places = np.array([p for _, _, p in self.texts] + [self.size], np.int64)
        names = sorted({lang for _, lang, _ in self.texts})
        code = np.array([names.index(lang) for _, lang, _ in self.texts], np.int64)
        lang = np.repeat(code, np.diff(places))
        there = words > 0
        prefix = np.zeros(len(words) + 1, np.uint64)
        hashed = np.array(self.numbers.hashes, np.uint64)[words]
        np.cumsum(hashed * _powers(len(words), BASE), out=prefix[1:])
        back = _powers(len(words), pow(BASE, -1, 1 << 64))

        def prints_at(i: np.ndarray, n: int) -> np.ndarray:
            salt = np.array([_salt(name, n) for name in names], np.uint64)
            f = (prefix[i + n] - prefix[i]) * back[i] + salt[lang[i]]
            return f >> np.uint64(64 - PRINT_BITS) & np.uint64(_MASK & ~3) | np.uint64(n)

        prints, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for n in orders:
            whole = there[:max(0, len(words) - n + 1)].copy()
            for k in range(1, n):
                whole &= there[k:len(words) - n + 1 + k]
            i = np.flatnonzero(whole)
            if n == LONGEST and pairs is not None:
                i = i[pairs.holds(prints_at(i, 2))]
                i = i[pairs.holds(prints_at(i + 1, 2))]
            prints.append(prints_at(i, n))
            at.append(i.astype(np.uint32))
        f, i = np.concatenate(prints), np.concatenate(at)
        order = np.argsort(f)
        f, i = f[order], i[order]
        padded = np.append(words, np.zeros(LONGEST, np.uint32))

        def other_phrase() -> np.ndarray:
            """Whether an entry's phrase is not the one before it."""
            out = np.ones(len(f), bool)
            out[1:] = lang[i[1:]] != lang[i[:-1]]
            for k in range(LONGEST):
                out[1:] |= (padded[i[1:] + k] != padded[i[:-1] + k]) & ((f[1:] & np.uint64(3)) > k)
            return out

        new = np.ones(len(f), bool)
        new[1:] = f[1:] != f[:-1]
        if (other_phrase() & ~new).any():  # a collision: order each fingerprint's occurrences by their words
            order = np.lexsort((*(np.where((f & np.uint64(3)) > k, padded[i + k], 0) for k in range(LONGEST)), lang[i], f))
            f, i = f[order], i[order]
            new[1:] = f[1:] != f[:-1]
            new |= other_phrase()
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(f)))
        totals = np.bincount(lang[there], minlength=len(names))
        return f[first], i[first], count, dict(zip(names, totals.tolist()))


_ENTRIES = "bucket int, prints binary, at binary, counts binary, texts binary, places binary, lang string, words long"
_SHARES = "block int, shares binary, lang string, words long"
#: ``mark`` says how many words, and has upper bits of the fingerprint: should two texts have one hash, they tell whose the share is.
_SHARE = np.dtype([("text", "<u8"), ("mark", "<u4"), ("at", "<u4"), ("count", "<u4")])


def mark_of(prints):
    """The mark of a fingerprint, or of an array of them."""
    return prints >> (PRINT_BITS - 30) & ~3 | prints & 3 if isinstance(prints, int) else (
        prints >> np.uint64(PRINT_BITS - 30) & np.uint64(_MASK & ~3) | prints & np.uint64(3)).astype(np.uint32)


def squeezed(values: np.ndarray) -> bytes:
    """An array compressed byte plane by byte plane: small numbers leave their high planes empty."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def expanded(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [expanded(b, kind) for b in column.to_pylist() if b]


def _entries(docs: DataFrame, buckets: int, flush_words: int, orders: tuple[int, ...], pairs=None) -> DataFrame:
    """Blocks of entries by bucket, a range of fingerprints; where single words are counted, a row for each flush and language has its words,
    in the buckets below 0. ``pairs`` is a broadcast ``Filter``."""
    names = ["bucket", "prints", "at", "counts", "texts", "places", "lang", "words"]
    types = [pa.int32(), *[pa.binary()] * 5, pa.string(), pa.int64()]

    def flushed(held: Held) -> Iterator[pa.RecordBatch]:
        prints, at, counts, totals = held.counted(orders, pairs.value if pairs else None)
        rows: list[tuple] = [(-1 - xxhash.xxh32_intdigest(lang.encode()) % 64, *[None] * 5, lang, n)
                             for lang, n in totals.items() if n and 1 in orders]
        texts, places = np.array([h for h, _, _ in held.texts], np.uint64), np.array([p for _, _, p in held.texts], np.uint32)
        bounds = np.searchsorted(prints, np.array([-(-(b << PRINT_BITS) // buckets) for b in range(1, buckets)], np.uint64))
        for b, (x, y) in enumerate(zip([0, *bounds], [*bounds, len(prints)])):
            if x < y:
                # the texts that this block points into, and places counted within them
                which = np.searchsorted(places, at[x:y], "right") - 1
                used, short = np.unique(which, return_inverse=True)
                offset = at[x:y] - places[which]
                steps = np.diff(prints[x:y], prepend=np.uint64(0))
                rows.append((b, squeezed(steps), squeezed(offset.astype("<u4")), squeezed(counts[x:y].astype("<u4")),
                             squeezed(texts[used]), squeezed(short.astype("<u4")), None, None))
        for k in range(0, len(rows), 64):
            yield _batch(rows[k:k + 64], names, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                if text:
                    held.add(lang, text)
                if held.size >= flush_words:
                    yield from flushed(held)
                    held = Held()
        if held.size:
            yield from flushed(held)

    return docs.mapInArrow(run, _ENTRIES)


def _added_up(entries: DataFrame, least: int, blocks: int) -> DataFrame:
    """The shares of fingerprints counted ``least`` times, by block of texts; the languages' words in block -1; the frequent pairs'
    fingerprints, each once, in block -2."""
    names, types = ["block", "shares", "lang", "words"], [pa.int32(), pa.binary(), pa.string(), pa.int64()]

    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            total: Counter = Counter()
            for lang, n in zip(group.column("lang").to_pylist(), group.column("words").to_pylist()):
                total[lang] += n
            return pa.Table.from_batches([_batch([(-1, None, lang, n) for lang, n in total.items()], names, types)])
        prints = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps in _arrays(group.column("prints"), "<u8")])
        counts = np.concatenate(_arrays(group.column("counts"), "<u4"))
        order = np.argsort(prints, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(prints[order]) != 0])
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        often = order[np.repeat(total >= least, np.diff(np.append(first, len(order))))]
        if not len(often):
            return pa.Table.from_batches([_batch([], names, types)])
        texts = [t[s] for t, s in zip(_arrays(group.column("texts"), "<u8"), _arrays(group.column("places"), "<u4"))]
        shares = np.empty(len(often), _SHARE)
        shares["text"], shares["mark"] = np.concatenate(texts)[often], mark_of(prints[often])
        shares["at"], shares["count"] = np.concatenate(_arrays(group.column("at"), "<u4"))[often], counts[often]
        block = (shares["text"] % np.uint64(blocks)).astype(np.int32)
        shares = shares[np.lexsort((shares["text"], block))]
        found, bounds = np.unique(np.sort(block), return_index=True)
        rows: list[tuple] = [(int(b), squeezed(p), None, None) for b, p in zip(found, np.split(shares, bounds[1:]))]
        twos = prints[order[first[total >= least]]]
        rows.append((-2, squeezed(np.diff(twos[(twos & np.uint64(3)) == 2], prepend=np.uint64(0))), None, None))
        return pa.Table.from_batches([_batch(rows, names, types)])

    return entries.groupBy("bucket").applyInArrow(run, _SHARES)


def _pair_filter(shares: DataFrame, size: int) -> Filter:
    """The filter of the frequent pairs. Its parts are put together in tasks; the driver gets ``size`` bits in all."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                at = np.unique(Filter.places(np.cumsum(expanded(blob, "<u8"), dtype=np.uint64), size))
                bounds = np.searchsorted(at, np.arange(1, FILTER_PARTS) * (size // FILTER_PARTS))
                rows = [(k, squeezed(np.diff(p, prepend=np.uint64(0)))) for k, p in enumerate(np.split(at, bounds)) if len(p)]
                yield _batch(rows, ["part", "places"], [pa.int32(), pa.binary()])

    def joined(group: pa.Table) -> pa.Table:
        part, bits = group.column("part")[0].as_py(), np.zeros(size // FILTER_PARTS, np.uint8)
        for steps in _arrays(group.column("places"), "<u8"):
            bits[np.cumsum(steps, dtype=np.uint64) - np.uint64(part * len(bits))] = 1
        return pa.Table.from_batches([_batch([(part, np.packbits(bits, bitorder="little").tobytes())], ["part", "bits"], [pa.int32(), pa.binary()])])

    parts = (shares.where("block = -2").select("shares").mapInArrow(spread, "part int, places binary")
             .groupBy("part").applyInArrow(joined, "part int, bits binary"))
    bits = np.zeros(size // 8, np.uint8)
    for row in parts.collect():  # FILTER_PARTS rows, ``size`` bits
        at = row["part"] * (size // FILTER_PARTS // 8)
        bits[at:at + size // FILTER_PARTS // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits)


def _bodies(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, text, lang, body): each task's distinct texts, compressed, by the block that their hash names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text and (h := text_hash(lang, text)) not in seen:
                    seen.add(h)
                    rows.append((h % blocks, h - (1 << 64) if h >> 63 else h, lang, packer.compress(text)))
            yield _batch(rows, ["block", "text", "lang", "body"], [pa.int32(), pa.int64(), pa.string(), pa.binary()])

    return docs.mapInArrow(run, "block int, text long, lang string, body binary")


def _spelled(shares: DataFrame, bodies: DataFrame) -> DataFrame:
    """(lang, n, phrase, count): every share read from its text."""
    def run(found: pa.Table, texts: pa.Table) -> pa.Table:
        wanted = np.concatenate([np.zeros(0, _SHARE), *_arrays(found.column("shares"), _SHARE)])
        wanted = wanted[np.argsort(wanted["text"], kind="stable")]
        bounds = np.flatnonzero(np.r_[True, np.diff(wanted["text"]) != 0]) if len(wanted) else np.zeros(0, np.int64)
        spans = dict(zip(wanted["text"][bounds].tolist(), zip(bounds.tolist(), [*bounds[1:].tolist(), len(wanted)])))
        total: dict[tuple[str, int], Counter] = defaultdict(Counter)
        done, opener = set(), zstandard.ZstdDecompressor()
        rows = list(zip(*(texts.column(c).to_pylist() for c in ("text", "lang", "body"))))
        texts_of = Counter(h for h, _, _ in set(rows))
        for h, lang, body in rows:
            span = spans.get(h & _MASK)
            if span is None or (lang, body) in done:
                continue
            done.add((lang, body))
            words = tokens(opener.decompress(body))
            alone = texts_of[h] == 1  # else each share belongs to the text that gives its fingerprint
            for mark, at, count in zip(*(wanted[c][span[0]:span[1]].tolist() for c in ("mark", "at", "count"))):
                phrase = words[at:at + (mark & 3)]
                if alone or mark_of(fingerprint(lang, phrase)) == mark:
                    total[lang, mark & 3][b" ".join(phrase)] += count
        rows = [(lang, n, phrase.decode(), count) for (lang, n), found in total.items() for phrase, count in found.items()]
        return pa.Table.from_batches([_batch(rows, ["lang", "n", "phrase", "count"], [pa.string(), pa.int32(), pa.string(), pa.int64()])])

    return (shares.where("block >= 0").select("block", "shares").groupBy("block").cogroup(bodies.groupBy("block"))
            .applyInArrow(run, "lang string, n int, phrase string, count long")
            .groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count")))


def phrase_counts(docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", flush_words: int = FLUSH_WORDS,
                  bucket_entries: int = BUCKET_ENTRIES, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, n, phrase, count) of every phrase of 1 to 3 words that occurs ``least`` times, (lang, words) of every language). Both are settled."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    # a word takes five bytes and more in running text, and stands for up to two entries in a pass
    buckets = max(1, -(-size * 2 // 5 // bucket_entries))
    short = settled(_added_up(_entries(rows, buckets, flush_words, (1, 2)), least, blocks))
    pairs = docs.sparkSession.sparkContext.broadcast(_pair_filter(short, filter_bits))
    long = _added_up(_entries(rows, buckets, flush_words, (3,), pairs), least, blocks)
    counts = settled(_spelled(short.unionByName(long), _bodies(rows, blocks)).where(F.col("count") >= least))
    return counts, short.where("block = -1").groupBy("lang").agg(F.sum("words").alias("words"))


def mine(docs: DataFrame, least: int = 10, best: int = 2000, swallowed: int = 50, text: str = "text", lang: str = "lang", **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases. A phrase is scored at the cut into two parts that scores
    lowest; one of which ``swallowed`` hundredths of the occurrences lie in one longer phrase is left out."""
    counts, totals = phrase_counts(docs, least, text, lang, **sizes)
    parts = F.split("phrase", " ")
    longer = counts.where(f"n = {LONGEST}").select("lang", "count", F.explode(F.array(
        *[F.array_join(F.slice(parts, k, LONGEST - 1), " ") for k in (1, 2)])).alias("phrase"))
    holds = longer.groupBy("lang", "phrase").agg(F.max("count").alias("held"))
    kept = (counts.where("n > 1").join(holds, ["lang", "phrase"], "left")
            .where(f"held is null or 100 * held < {int(swallowed)} * count"))
    cut = kept.select("lang", "phrase", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"), "n")
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " ").alias("first"),
                     F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest"))
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("count").alias(name))
    scored = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # a, l and r below 10^15: the dividend stays within 38 digits, and no score is over a million
    wide = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    scored = scored.withColumn("score", F.call_function("div", F.lit(MILLION).cast("decimal(7,0)") * (wide["a"] * wide["a"]), wide["l"] * wide["r"]))
    lowest = (scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
              .select("lang", "phrase", "a", "low.l", "low.r", "low.score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    for of_part in (F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)), None):  # each part's best first, then the language's
        by = Window.partitionBy("lang", *([] if of_part is None else ["part"])).orderBy(*order)
        ranked = lowest if of_part is None else lowest.withColumn("part", of_part)
        lowest = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best).drop("part")
    return lowest.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
