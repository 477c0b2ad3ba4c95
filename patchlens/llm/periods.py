"""Periodic runs of words by block convolution.

A run is a maximal stretch of words with smallest period q that is at least ``EXPONENT`` periods and ``LEAST`` words long. Periods
are searched at dyadic scales. At scale u = 1, 2, 4, ... a document is cut into blocks of 3u words; a run with a period
from 2u to 4u - 1 (1 to 3 at the first scale) is long enough to hold a whole block and the block's next occurrence one period on.
So each block's occurrences in the window that follows are located: the sum of squared differences between block and window is a
convolution, done exactly with a number-theoretic transform of 8u points modulo a prime, and is zero where nothing
differs. The distance from block to occurrence is a seed: seeds of neighbouring blocks at one distance join to chains, and a chain is
extended word by word in both directions to the maximal stretch.

Two exact savings come before the transform and the extension. A block holding a word that does not recur within the largest distance
of its scale has no occurrence there. And what lies in a run of a smaller period that is already known repeats that period, so
it is no run of its own. A sum that is a multiple of the prime by chance is found out by comparing the words.

Blocks of all documents of a batch are transformed together; no rows are shuffled. A task holds one group of documents of about
``GROUP_WORDS`` words, or one longer document, and ``CELLS`` numbers of a transform.

Edge cases: a null or empty text, or one without a word, has no runs and collapses to the empty text; very long texts are searched whole, in time
proportional to n log(n)^2 for ordinary ones; repeated rows are answered one by one; a null key is kept; an empty table gives an empty
result; columns other than the two named are never read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import small_batches

# What counts as a run.
EXPONENT, LEAST = 4, 6
#: 15 * 2^27 + 1, and a generator of its multiplicative group: transforms of up to 2^27 points, products within 64 bits.
PRIME, GENERATOR = 2013265921, 31
GROUP_WORDS = 1 << 18
#: Numbers of one transform's matrix, and compared at once by an extension.
CELLS = 1 << 20

_P = np.uint64(PRIME)


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 to size/2 - 1 of a size-th root of unity."""
    w = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    w = pow(w, PRIME - 2, PRIME) if inverse else w
    powers = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < len(powers):  # doubling: the next stretch is the known one times a power
        more = min(done, len(powers) - done)
        powers[done:done + more] = powers[:more] * np.uint64(pow(w, done, PRIME)) % _P
        done += more
    return powers


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, values in bit-reversed order."""
    x = rows % _P
    half = x.shape[1] // 2
    while half:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        high = (a + (_P - b)) % _P * _roots(2 * half, False) % _P
        total = a + b
        pairs[:, :, 0], pairs[:, :, 1] = np.minimum(total, total - _P), high
        half //= 2
    return x


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows whose ``transform`` is given."""
    x, half, size = rows.copy(), 1, rows.shape[1]
    while half < size:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * _roots(2 * half, True) % _P
        total, rest = a + b, a + (_P - b)
        pairs[:, :, 0], pairs[:, :, 1] = np.minimum(total, total - _P), np.minimum(rest, rest - _P)
        half *= 2
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % _P


def squared_differences(blocks: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """For each row, modulo the prime: the sum of squared differences between the block and the window from each place on where it
    fits. ``size`` is a power of two, at least the window's length."""
    n, places = blocks.shape[1], windows.shape[1] - blocks.shape[1] + 1
    x, y = np.zeros((len(blocks), size), np.uint64), np.zeros((len(blocks), size), np.uint64)
    x[:, :n], y[:, :windows.shape[1]] = blocks[:, ::-1], windows
    products = inverse(transform(x) * transform(y) % _P)[:, n - 1:n - 1 + places]
    squares = np.cumsum(np.pad(windows * windows % _P, ((0, 0), (1, 0))), axis=1)  # below 2^31 times the length
    there = squares[:, n:] - squares[:, :-n]
    here = (blocks * blocks % _P).sum(axis=1, keepdims=True)
    return (there + here + (_P - products) * np.uint64(2)) % _P


def _reach(t: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many words in a row, from ``at`` on in direction ``step``, equal the word ``distance`` further. ``t`` begins and ends with
    words that occur once."""
    got, active, width, last = np.zeros(len(at), np.int64), np.arange(len(at)), 16, len(t) - 1
    while len(active):
        more = []
        for part in np.array_split(active, -(-len(active) * width // CELLS)):
            i = np.clip(at[part, None] + step * (got[part, None] + np.arange(width)), 0, last)
            same = t[i] == t[np.minimum(i + distance[part, None], last)]
            whole = same.all(axis=1)
            got[part] += np.where(whole, width, np.argmin(same, axis=1))
            more.append(part[whole])
        active, width = np.concatenate(more), min(2 * width, CELLS)
    return got


def _covered(runs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run (rows of start, end, period, by start) holds everything from start to end."""
    if not len(runs):
        return np.zeros(len(start), bool)
    furthest = np.maximum.accumulate(runs[:, 1])
    before = np.searchsorted(runs[:, 0], start, "right")
    return (before > 0) & (furthest[np.maximum(before, 1) - 1] >= end)


def _seeds(t: np.ndarray, blocks: np.ndarray, ends: np.ndarray, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) wherever the block of ``length`` words recurs ``low`` to ``high`` words on, within its document."""
    size = 1 << (length + high - 1).bit_length()
    found, distances = [], []
    for at in range(0, len(blocks), max(1, CELLS // size)):
        c, end = blocks[at:at + max(1, CELLS // size)], ends[at:at + max(1, CELLS // size)]
        window = t[np.minimum(c[:, None] + np.arange(length + high), len(t) - 1)]
        row, q = np.nonzero(squared_differences(window[:, :length], window, size)[:, low:] == 0)
        q += low
        inside = c[row] + q + length <= end[row]
        found.append(c[row[inside]])
        distances.append(q[inside])
    return np.concatenate(found), np.concatenate(distances)


def _same(t: np.ndarray, c: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Whether the block at c and what is q words on hold the same words."""
    out = np.zeros(len(c), bool)
    for part in np.array_split(np.arange(len(c)), max(1, -(-len(c) * length // CELLS))):
        i = c[part, None] + np.arange(length)
        out[part] = (t[i] == t[i + q[part, None]]).all(axis=1)
    return out


def find_runs(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period. ``t`` has the words' numbers, documents from ``starts`` to ``ends``; words before, between
    and after them occur once."""
    runs = np.zeros((0, 3), np.int64)
    order = np.argsort(t, kind="stable")
    recurs = np.full(len(t), len(t), np.int64)  # distance to the word's next occurrence
    again = t[order[1:]] == t[order[:-1]]
    recurs[order[:-1][again]] = np.diff(order)[again]
    words, u = ends - starts, 1
    residues = (t % _P * np.uint64(1103515245) + np.uint64(12345)) % _P
    while len(words) and words.max() >= max(LEAST, EXPONENT * (1 if u == 1 else 2 * u)):
        length, low, high = 3 * u, 1 if u == 1 else 2 * u, 4 * u - 1
        many = np.maximum(0, (words - low) // length)
        many[words < max(LEAST, EXPONENT * low)] = 0
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        blocks, block_ends = np.repeat(starts, many) + number * length, np.repeat(ends, many)
        lonely = np.cumsum(np.pad(recurs > high, (1, 0)))
        known = _covered(runs, blocks, np.minimum(blocks + length + high, block_ends))
        live = (lonely[blocks + length] == lonely[blocks]) & ~known
        if live.any():
            c, q = _seeds(residues, blocks[live], block_ends[live], length, low, high)
            for least, most in ((1, 1), (2, 3)) if u == 1 else ((low, high),):  # within a group no period divides another
                of = (q >= least) & (q <= most)
                runs = _extended(t, c[of], q[of], length, runs)
        u *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _extended(t: np.ndarray, c: np.ndarray, q: np.ndarray, length: int, runs: np.ndarray) -> np.ndarray:
    """``runs`` and the runs that the seeds (c, q) lie in."""
    fresh = ~_covered(runs, c, c + q + length)
    c, q = c[fresh], q[fresh]
    true = _same(t, c, q, length)
    c, q = c[true], q[true]
    if not len(c):
        return runs
    order = np.lexsort((c, q))
    c, q = c[order], q[order]
    first = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1] + length)]  # of a chain of neighbouring blocks
    last = np.r_[first[1:], True]
    c, end, q = c[first], c[last] + length, q[first]
    start = c - _reach(t, c - 1, q, -1)
    end = end + _reach(t, end, q, 1) + q
    long = end - start >= np.maximum(LEAST, EXPONENT * q)
    new = np.unique(np.column_stack([start, end, q])[long], axis=0)
    new = new[~_covered(runs, new[:, 0], new[:, 1])]
    both = np.concatenate([runs, new])
    return both[np.argsort(both[:, 0], kind="stable")]


def _grouped(texts: list[bytes]) -> list[tuple[list, bytes]]:
    """(runs, collapsed text) of each text; the texts are searched together."""
    numbers: dict[bytes, int] = {}
    words = [t.split() for t in texts]  # of bytes: exactly at the ASCII white space
    parts = [np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.uint64) for ws in words]
    once = len(numbers)  # numbers of words that occur once: one before each document, one at the end
    t = np.concatenate([x for k, p in enumerate(parts) for x in (np.array([once + k], np.uint64), p)] + [np.array([once + len(parts)], np.uint64)])
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    runs = find_runs(t, starts, starts + sizes)
    bounds = np.searchsorted(runs[:, 0], np.append(starts, len(t)))
    out = []
    for k, ws in enumerate(words):
        own = runs[bounds[k]:bounds[k + 1]] - [starts[k], starts[k], 0]
        if len(own):
            over = np.zeros(len(ws) + 1, np.int64)
            np.add.at(over, own[:, 0] + own[:, 2], 1)
            np.add.at(over, own[:, 1], -1)
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(over[:-1]) == 0)]
        out.append((own.tolist(), b" ".join(ws)))
    return out


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed): the runs as (start, length, period) in words, by start, then period; the words joined by one
    space, without those that a run repeats after its first period."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found, held, size = [], [], 0
            for k, t in enumerate(texts):
                held.append(t or b"")
                size += len(held[-1]) // 6
                if size > GROUP_WORDS or k == len(texts) - 1:
                    found += _grouped(held)
                    held, size = [], 0
            flat = np.array([r for runs, _ in found for r in runs], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])],
                                                names=["start", "length", "period"])
            bounds = np.cumsum([0, *(len(runs) for runs, _ in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), struct), pa.array([c for _, c in found], pa.binary()).cast(pa.string())],
                names=["id", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    return (docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
            .mapInArrow(run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", key))
