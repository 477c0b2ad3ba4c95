"""SimHash near-duplicates with Pigeonring filtering.

A fingerprint's 64 bits are cut into a ring of ``RING`` segments. Two fingerprints that differ in at
most ``max_bits`` bits have a segment from which every chain of consecutive segments stays within its
proportional budget: ``l`` segments differ in at most ``floor(l * max_bits / RING)`` bits. Candidates
come from an equi-join on a first segment within its budget (the probing side lists the segment's
neighbours); longer chains prune them before the full Hamming check.

Edge cases: a null or wordless text has fingerprint zero and links like any other; texts shorter than
a shingle are one shingle; equal fingerprints are one node of the graph, however many rows carry
them; rows with a null id take part, and a component of such rows only has a null id; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import arrow_rows, settled

RING = 3
SEED = 42
#: Shingles hashed at a time: a long text never needs more memory than this many hashes.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit majority of the XXH64 hashes of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:min(n, at + BLOCK)], ends[at:at + BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    def run(batch: dict[str, list]) -> dict[str, list]:
        seen: dict = {}
        out = []
        for t in batch["text"]:
            if t not in seen:
                fp = fingerprint(t, shingle)
                seen[t] = fp - (1 << 64) if fp >> 63 else fp
            out.append(seen[t])
        return {"id": batch["id"], "fp": out}

    kind = docs.schema[key].dataType.simpleString()
    return (arrow_rows(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {kind}, fp long")
            .withColumnRenamed("id", key))


def _segments(ring: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; widths differ by one at most."""
    edges = [round(64 * k / ring) for k in range(ring + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _neighbours(width: int, bits: int) -> list[int]:
    """Masks of a segment's values within ``bits`` flips."""
    return [sum(1 << b for b in flips) for k in range(bits + 1) for flips in combinations(range(width), k)]


def links(fps: DataFrame, max_bits: int, ring: int = RING) -> DataFrame:
    """(a, b), a < b: distinct fingerprints of ``fps.fp`` within ``max_bits`` differing bits; every
    such pair at least once."""
    cuts = _segments(ring)
    budget = [math.floor(k * max_bits / ring) for k in range(ring + 1)]
    key = lambda k, value: F.struct(F.lit(k).cast("byte").alias("segment"), value.alias("value"))
    stored = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[
        key(k, _segment(F.col("fp"), *cut)) for k, cut in enumerate(cuts)])).alias("at"))
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.array(*[
        key(k, _segment(F.col("fp"), *cut).bitwiseXOR(F.lit(mask)))
        for k, cut in enumerate(cuts) for mask in _neighbours(cut[1], budget[1])])).alias("at"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    spent = [F.bit_count(_segment(differ, *cut)) for cut in cuts]
    chains = F.lit(False)
    for k in range(ring):
        viable = F.lit(True)
        for length in range(1, ring + 1):
            viable &= sum((spent[(k + j) % ring] for j in range(1, length)), spent[k]) <= budget[length]
        chains |= (F.col("at.segment") == k) & viable
    return (probes.join(stored, "at").where((F.col("a") < F.col("b")) & chains & (F.bit_count(differ) <= max_bits))
            .select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of undirected ``edges`` (a, b): root is the smallest node reachable.
    Alternates star operations that point every node at the smallest node it knows, until nothing moves;
    each round's edges, never more than the first round's, are written to the shared folder."""
    stars = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: larger neighbours of a node point at the smallest node of its neighbourhood
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: a node and its smaller neighbours point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = settled(small.select("e.*").where("u <> v").distinct())
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, key: str = "doc_id",
                    text: str = "text", ring: int = RING) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links of fingerprints
    within ``max_bits`` bits. Rows of one fingerprint are pre-aggregated to one node, so copies are
    never paired."""
    marked = settled(with_fingerprints(docs, shingle, key, text))
    nodes = settled(marked.groupBy("fp").agg(F.min(key).alias("first_key")))
    edges = settled(links(nodes.select("fp"), max_bits, ring))
    if edges.isEmpty():
        named = nodes.select("fp", F.col("first_key").alias("component_id"))
    else:
        roots = components(edges)
        rooted = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
                  .select("fp", "first_key", F.coalesce("root", "fp").alias("root")))
        smallest = rooted.groupBy("root").agg(F.min("first_key").alias("component_id"))
        named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")
