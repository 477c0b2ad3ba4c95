"""Secrets by pattern and by character statistics, in DataFrame functions only.

Pattern spans come from ``regexp_extract_all`` and ``split`` with one pattern: the pieces between the hits give each
hit's place in code points. Further spans come from two character Markov models, one of random strings, one of
ordinary identifiers and words: long tokens whose log-likelihood ratio favours the random model are added as kind ``random``.

The models are trained here from samples labelled by the patterns: values found by them are random,
words of a bounded sample of the texts (``SAMPLE_ROWS`` expected) that are no such values are ordinary. Each is a table of log
probabilities over pairs of ``ALPHABET`` characters, smoothed towards equal odds, so its size is fixed and without any
sample both are uniform and nothing is added.

Edge cases: a null or empty text has no spans; overlapping spans of different pattern kinds are all reported; a random
span never touches a pattern span; rows repeat as they are; ties of start go by kind as listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The kinds and their patterns; the last number is the least length of what counts (of the
# value after the separator for the first).
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = "^(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
VALUE_CHARS = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A token that the models judge, and a word they may learn from.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
WORD = "[A-Za-z_][A-Za-z0-9_]{4,}"
SAMPLE_ROWS = 5_000
#: Log-likelihood ratio, in all and a character, from which a token is random.
LEAST_TOTAL, LEAST_MEAN = 10.0, 0.5
#: Weight of equal odds in a pair's probability.
SMOOTHING = 0.5


def _hits(text: Column, pattern: str) -> Column:
    """array of (start, end, value) of the pattern's leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
                       lambda before, value: F.struct(F.length(before).cast("long").alias("skip"), value.alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,value:string>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        a = state["at"] + part["skip"]
        b = a + F.length(part["value"])
        return F.struct(b.alias("at"), F.concat(state["out"], F.array(F.struct(
            a.alias("start"), b.alias("end"), part["value"].alias("value")))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["out"]).otherwise(
        F.array().cast("array<struct<start:long,end:long,value:string>>"))


def _kind(hits: Column, rank: int, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind"), h["value"].alias("value")))


def pattern_spans(text: Column) -> Column:
    """array of (start, rank, end, kind, value), by start, then kind as listed. A hit whose value is too short is
    dropped, and what it covered stays covered."""
    t = F.coalesce(text, F.lit(""))
    value = lambda h: F.regexp_replace(h["value"], ASSIGN_HEAD, "")
    assign = F.filter(_hits(t, ASSIGN), lambda h: F.length(value(h)) >= VALUE_CHARS)
    return F.array_sort(F.concat(_kind(assign, 0, KINDS[0]), _kind(_hits(t, ACCESS), 1, KINDS[1]), _kind(_hits(t, HEX), 2, KINDS[2])))


def _pairs(value: Column) -> Column:
    """Numbers of the neighbouring character pairs, 0 to len(ALPHABET)**2 - 1; pairs with other characters are left out."""
    code = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    both = F.zip_with(F.slice(code, F.lit(1), F.greatest(F.size(code) - 1, F.lit(0))),
                      F.slice(code, F.lit(2), F.greatest(F.size(code) - 1, F.lit(0))),
                      lambda a, b: F.when((a >= 0) & (b >= 0), a * F.lit(len(ALPHABET)) + b))
    return F.filter(both, lambda p: p.isNotNull())


def _pair_counts(values: DataFrame, name: str) -> DataFrame:
    return (values.select(F.explode(_pairs(F.col("value"))).alias("pair"))
            .groupBy("pair").agg(F.count(F.lit(1)).alias(name)))


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each character given the one before: a number for each pair
    of alphabet characters."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = len(ALPHABET)
    values = (rows.select(F.explode(pattern_spans(F.col("text"))).alias("s"))
              .select(F.regexp_replace("s.value", ASSIGN_HEAD, "").alias("value")))
    total = docs.count()
    share = 1.0 if total <= sample_rows else sample_rows / total
    unit = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    words = (rows.where(unit <= share).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"))
             .where(~F.col("value").rlike(f"{HEX}|{ACCESS}") & (F.length("value") < 40)))
    counts = _pair_counts(values, "random").join(_pair_counts(words, "ordinary"), "pair", "full")
    random, ordinary = [SMOOTHING] * size ** 2, [SMOOTHING] * size ** 2
    for r in counts.collect():  # len(ALPHABET)**2 rows at most
        random[r["pair"]] += r["random"] or 0
        ordinary[r["pair"]] += r["ordinary"] or 0
    rows_of = lambda t: [sum(t[k:k + size]) for k in range(0, size ** 2, size)]
    p, q = rows_of(random), rows_of(ordinary)
    return [math.log(random[k] / p[k // size]) - math.log(ordinary[k] / q[k // size]) for k in range(size ** 2)]


def _ratio(value: Column, model: list[float]) -> Column:
    """Sum of the pairs' ratios."""
    table = F.split(F.lit(" ".join(f"{x:.4f}" for x in model)), " ").cast("array<double>")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda total, pair: total + F.get(table, pair))


def find(docs: DataFrame, model: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): pattern spans and random tokens as (start, rank, end, kind, value), by start, then kind."""
    rank = len(KINDS)
    found = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("whole")).select(
        key, pattern_spans(F.col("whole")).alias("known"), _kind(_hits(F.col("whole"), TOKEN), rank, "random").alias("tokens"))
    clear = F.filter("tokens", lambda t: ~F.exists("known", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    random = F.filter(clear, lambda t: _ratio(t["value"], model) >= F.greatest(
        F.lit(LEAST_TOTAL), F.length(t["value"]) * F.lit(LEAST_MEAN)))
    return found.select(key, F.when(F.size("tokens") == 0, F.col("known")).otherwise(
        F.array_sort(F.concat("known", random))).alias("spans"))
