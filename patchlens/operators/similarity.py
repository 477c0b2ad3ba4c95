"""Vectors per model, cosine, verdict at a threshold.

Two vector families:
* lexical models (default): term-frequency vectors under a named tokenizer. Terms are
  counted per item, in Arrow batches; the cosine is exact.
* dense vectors: ``array<float>`` columns supplied by the caller; cosine is
  ``aggregate(zip_with(...))`` in the JVM.

Models are applied as a generator over a literal array (one row per item and model),
never as a join, so the model list costs nothing to distribute. A model that cannot score an item
says why in ``error``; the others still score it.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise
from ..schemas import ERROR_EMPTY_TEXT, ERROR_MISSING_VECTOR, ERROR_UNEQUAL_LENGTH, ERROR_ZERO_NORM

# ---- fixed values
MATCH_THRESHOLD = 0.6
SHOWN_FORMAT = "%.2f"
# ---- end of fixed values

#: Rows whose n-grams are counted at once; their numbers take some hundred bytes a part.
_ROWS = 512

#: Buckets of stored text tables unless a caller says otherwise.
BUCKETS = 64

WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def words(c: Column) -> Column:
    return F.filter(F.split(c, WORD_SPLIT), lambda t: t != "")


def _adjacent(a: Column, sep: str = "") -> Column:
    """Pairs of neighbours of an array, linear time (no per-element indexing)."""
    return F.filter(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))),
                               lambda x, y: F.concat(x, F.lit(sep), y)),
                    lambda t: t.isNotNull())


def word_bigrams(c: Column) -> Column:
    return _adjacent(words(c), " ")


def split_words(c: Column) -> Column:
    """``words`` with empty ones among them, for ``ngram_sums``, which passes these over; no lambda runs over every word."""
    return F.split(c, WORD_SPLIT)


# of tokenizers whose terms are n neighbours in a text: the parts that are neighbours (None: its characters) and n; see ``ngram_sums``
words.grams, word_bigrams.grams = (split_words, 1), (split_words, 2)


def char_ngrams(n: int) -> Callable[[Column], Column]:
    """Character n-grams (code points of the basic plane), linear time."""
    def tok(c: Column) -> Column:
        chars = F.filter(F.split(c, ""), lambda t: t != "")
        grams = chars
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(1))),
                               lambda x, y: F.concat(x, y))
        # the regex engine steps by UTF-16 units, so it serves texts without characters of two
        return F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), F.filter(grams, lambda t: t.isNotNull())).otherwise(
            F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))
    tok.grams = (None, n)
    return tok


# name -> tokenizer over normalised text; stand-ins for sentence encoders, all exact
LEXICAL_MODELS: dict[str, Callable[[Column], Column]] = {
    "word_tf": words,
    "word_bigram_tf": word_bigrams,
    "char3_tf": char_ngrams(3),
}


def cosine(a: Column, b: Column) -> Column:
    """Dense cosine in double precision; null when either vector has zero norm or
    the lengths differ."""
    a = a.cast("array<double>")
    b = b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
    nb = F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v * v)
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot / (F.sqrt(na) * F.sqrt(nb)))


def vector_error(a: Column, b: Column) -> Column:
    """Why two vectors have no cosine; null when they have one."""
    blank = lambda v: ~F.exists(v, lambda x: x != 0)
    return (F.when(a.isNull() | b.isNull(), F.lit(ERROR_MISSING_VECTOR))
            .when(F.size(a) != F.size(b), F.lit(ERROR_UNEQUAL_LENGTH))
            .when(blank(a) | blank(b), F.lit(ERROR_ZERO_NORM)))


def two_places(x: Column) -> Column:
    """The text of a double with two decimals, rounded from its exact binary value, ties to even, as Python's ``.2f`` does.

    100 x is held exactly as a product and its rounding error (x is split into two halves of 26 bits, each of which times 100 is
    exact), so its distance to the middle between two integers has the right sign. Exact below 2^44; larger numbers, infinities and NaN are
    formatted by Spark.
    """
    a = F.abs(x)
    product, shifted = a * 100.0, a * float((1 << 27) + 1)
    high = shifted - (shifted - a)
    error = (high * 100.0 - product) + (a - high) * 100.0
    whole = F.floor(product)
    over = (product - whole.cast("double") - 0.5) + error
    n = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(a < float(1 << 44), text).otherwise(F.format_string(SHOWN_FORMAT, x))


def verdict(score: Column, threshold: float = MATCH_THRESHOLD):
    """M3/M4: (shown, is_match). The verdict uses the unrounded score."""
    return (F.when(score.isNotNull(), two_places(score)).alias("shown"),
            F.coalesce(score >= F.lit(threshold), F.lit(False)).alias("is_match"))


def distinct_terms(*sides: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Counts of the distinct terms of each row, rows being lists of terms on one or more sides: (terms, row, index of the term, a count for
    each side), in row order. Null lists and null terms count nothing."""
    width, n = len(sides), len(sides[0])
    flat = pa.concat_arrays([s.flatten() for s in sides])
    lengths = [pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False) for s in sides]
    row = np.concatenate([np.repeat(np.arange(n, dtype="int64"), k) for k in lengths])
    side = np.repeat(np.arange(width), [int(k.sum()) for k in lengths])
    coded = flat.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    place = (row * size + coded.indices.fill_null(0).to_numpy(zero_copy_only=False)) * width + side
    if coded.indices.null_count:
        place = place[coded.indices.is_valid().to_numpy(zero_copy_only=False)]
    found, times = np.unique(place, return_counts=True)
    key = found // width
    first = np.diff(key, prepend=-1) != 0
    at, key = np.cumsum(first) - 1, key[first]
    counts = []
    for k in range(width):
        here = found % width == k
        counts.append(np.zeros(len(key)))
        counts[-1][at[here]] = times[here]
    return coded.dictionary, key // size, key % size, counts


_SUMS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("dot", "na", "nb")])
_COUNTS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())]))


def lists_by_row(row: np.ndarray, n: int, **fields: pa.Array) -> pa.Array:
    """One list of structs for each of ``n`` rows, from entries in row order."""
    ends = np.searchsorted(row, np.arange(n + 1)).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([*fields.values()], [*fields]))


def _product_sums(left: pa.Array, right: pa.Array) -> pa.Array:
    _, row, _, (a, b) = distinct_terms(left, right)
    return pa.StructArray.from_arrays([pa.array(np.bincount(row, x, len(left))) for x in (a * b, a * a, b * b)], ["dot", "na", "nb"])


def _term_counts(left: pa.Array, right: pa.Array) -> pa.Array:
    terms, row, index, (a, b) = distinct_terms(left, right)
    return lists_by_row(row, len(left), term=terms.take(pa.array(index)), a=pa.array(a), b=pa.array(b))


def _numbered(texts: pa.Array) -> tuple[np.ndarray, int, np.ndarray]:
    """(number of each part, how many numbers, how many parts in each text) of texts that are strings, or lists of parts, of which empty ones are
    passed over."""
    if pa.types.is_list(texts.type):
        parts = texts.flatten()
        text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
        there = pc.fill_null(pc.not_equal(parts, ""), False)
        coded = parts.filter(there).dictionary_encode()
        return (coded.indices.to_numpy(zero_copy_only=False).astype("int64"), len(coded.dictionary),
                np.bincount(text[there.to_numpy(zero_copy_only=False)], minlength=len(texts)))
    strings = [b.decode("utf-8", "replace") if b else "" for b in texts.cast(pa.binary()).to_pylist()]
    points = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype("int64")
    used = np.zeros(points.max(initial=0) + 1, bool)
    used[points] = True
    return (np.cumsum(used) - 1)[points], int(used.sum()), np.fromiter(map(len, strings), "int64", len(strings))


def ngram_sums(left: pa.Array, right: pa.Array, sizes: list[int]) -> list[pa.Array]:
    """For each n of ``sizes``, of rows that are lists of texts on two sides: the sums of products of the counts of their n-grams, which do
    not reach over a text's end. A text is a string, whose parts are its characters, or a list of parts. N-grams are numbers, never texts."""
    rows, texts = len(left), [s.flatten() for s in (left, right)]
    row = np.concatenate([np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)) for s in (left, right)])
    part, base, lengths = _numbered(pa.concat_arrays(texts))
    text = np.repeat(np.arange(len(row)), lengths)
    # twice the row, and one more on the right side
    place = row * 2 + (np.arange(len(row)) >= len(texts[0]))
    out = []
    for n in sizes:
        gram, count = part, max(base, 1)
        for k in range(1, n):
            if count * max(base, 1) * (rows + 1) * 2 >= 1 << 63:
                found, gram = np.unique(gram, return_inverse=True)
                count = max(len(found), 1)
            gram, count = gram[:-1] * base + part[k:], count * max(base, 1)
        inside = text[:len(gram)] == text[len(text) - len(gram):]
        at = place[text[:len(gram)][inside]]
        # one key for a gram of a row, its lowest bit the side
        key, times = np.unique((((at >> 1) * count + gram[inside]) << 1) | (at & 1), return_counts=True)
        of, times = (key >> 1) // count, times.astype("float64")
        both = np.flatnonzero((key[:-1] ^ 1) == key[1:]) if len(key) else key
        both = both[key[both] & 1 == 0]
        sums = [np.bincount(of[both], times[both] * times[both + 1], rows)]
        sums += [np.bincount(of[key & 1 == side], times[key & 1 == side] ** 2, rows) for side in (0, 1)]
        out.append(pa.StructArray.from_arrays([pa.array(x.astype("float64")) for x in sums], ["dot", "na", "nb"]))
    return out


def _sums_of(sizes: list[int]) -> Callable:
    """``ngram_sums`` of a batch, ``_ROWS`` rows at a time."""
    def some(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(ngram_sums(left, right, sizes), [f"n{k}" for k in range(len(sizes))])

    def sums(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(left.slice(k, _ROWS), right.slice(k, _ROWS)) for k in range(0, max(len(left), 1), _ROWS)])
    return sums


def _ngram_products(models: dict[str, Callable], texts: str, sides: tuple[str, str]) -> dict[str, Column]:
    """The sums of products of each model whose terms are n-grams, from a list of texts; parts are made once for all models that share them."""
    bases: dict[Callable | None, list[str]] = {}
    for name, tok in models.items():
        bases.setdefault(tok.grams[0], []).append(name)
    out = {}
    for base, names in bases.items():
        kind = T.StructType([T.StructField(f"n{k}", _SUMS) for k in range(len(names))])
        lists = [F.col(texts)[side] if base is None else F.transform(F.col(texts)[side], base) for side in sides]
        found = F.arrow_udf(_sums_of([models[name].grams[1] for name in names]), kind)(*lists)
        out |= {name: found[f"n{k}"] for k, name in enumerate(names)}
    return out


def _products(left: Column, right: Column) -> Column:
    return F.arrow_udf(_product_sums, _SUMS)(left, right)


def _counts(left: Column, right: Column) -> Column:
    return F.arrow_udf(_term_counts, _COUNTS)(left, right)


def all_terms(tok: Callable[[Column], Column], text: str, more: str = "_more") -> Column:
    """The terms of an item's column ``text`` and of the same field of ``more``, the further rows of its key (null: none)."""
    none = F.array().cast("array<string>")
    rest = F.flatten(F.transform(more, lambda t: F.coalesce(tok(t[text]), none)))
    own = F.coalesce(tok(F.col(text)), none)
    return F.when(F.col(more).isNull(), own).otherwise(F.concat(own, rest))


def score_lexical(pairs: DataFrame, key: str = "pair_id", left: str = "summary", right: str = "explanation",
                  models: dict | None = None, threshold: float = MATCH_THRESHOLD,
                  normalise_text: bool = True, error: str | None = None, dealt: bool = False) -> DataFrame:
    """(key, left text, right text) -> (key, model, score, shown, is_match, error).

    One row per (key, model) out; without terms on a side the score is null, with the reason. ``error`` names a column
    of reasons already known. Texts of one key are brought together once, as texts: their terms are made and counted
    where they lie, in Arrow batches of whole items, and never become rows of an aggregation, whose memory
    and spills would grow with all terms of a task. Terms that are n neighbours in a text are counted as numbers, from
    the parts that models share (``ngram_sums``).

    A model is a tokenizer, whose terms weigh the same, or a fitted ``encoder.HashedIdf``, whose table of weights, bounded by
    its number of buckets, is broadcast to the distinct terms of each item. ``dealt`` says that rows are partitioned by the key already, as those of
    bucketed tables are; the texts then stay where they are.
    """
    models = models or LEXICAL_MODELS
    norm = normalise if normalise_text else (lambda c: c)
    known = F.col(error) if error else F.lit(None).cast("string")
    texts = pairs.select(F.col(key), norm(F.col(left)).alias("_lt"), norm(F.col(right)).alias("_rt"), known.alias("_e"))
    texts = texts if dealt else texts.repartition(key)
    grouped = texts.groupBy(key, "_e").agg(F.collect_list(F.struct("_lt", "_rt")).alias("_ts"))
    grams = {name: m for name, m in models.items() if hasattr(m, "grams") and not hasattr(m, "weights")}
    items = grouped.select(key, "_e", *[F.get("_ts", 0)[side].alias(side) for side in ("_lt", "_rt")],
                           F.when(F.size("_ts") > 1, F.slice("_ts", 2, F.size("_ts"))).alias("_more"), "_ts")
    products = _ngram_products(grams, "_ts", ("_lt", "_rt"))
    parts = []
    for name, m in models.items():
        if name in products:
            parts.append(F.struct(F.lit(name).alias("model"), products[name].alias("sums"), F.lit(None).cast(_COUNTS).alias("counts")))
            continue
        tok = getattr(m, "terms", m)
        sides = [all_terms(tok, side) for side in ("_lt", "_rt")]
        sums = _products(*sides) if not hasattr(m, "weights") else F.lit(None).cast(_SUMS)
        counts = _counts(*sides) if hasattr(m, "weights") else F.lit(None).cast(_COUNTS)
        parts.append(F.struct(F.lit(name).alias("model"), sums.alias("sums"), counts.alias("counts")))
    rows = items.select(key, "_e", F.explode(F.array(*parts)).alias("_s"))
    fitted = {name: m for name, m in models.items() if hasattr(m, "weights")}
    if fitted:
        rows = rows.select(key, "_e", F.col("_s.model").alias("model"), F.col("_s.sums").alias("sums"), F.explode_outer("_s.counts").alias("c"))
        tables = [m.weights.select(F.lit(name).alias("model"), F.col("bucket").cast("string").alias("term"), "weight") for name, m in fitted.items()]
        rows = rows.withColumn("term", F.col("c.term")).join(F.broadcast(reduce(DataFrame.unionByName, tables)), ["model", "term"], "left")
        unseen = F.lit(1.0)
        for name, m in fitted.items():
            unseen = F.when(F.col("model") == name, F.lit(m.unseen)).otherwise(unseen)
        weight = F.coalesce("weight", unseen)
        a, b = F.col("c.a") * weight, F.col("c.b") * weight
        of = lambda name, product: F.coalesce(F.col("sums")[name], product, F.lit(0.0))
        rows = rows.select(key, "_e", "model", of("dot", a * b).alias("dot"), of("na", a * a).alias("na"), of("nb", b * b).alias("nb"))
    else:
        rows = rows.select(key, "_e", "_s.model", "_s.sums.*")
    # without weights there is one row for each key and model by now; a Python projection forgets how stored texts are dealt
    sums = rows if dealt and not fitted else rows.groupBy(key, "_e", "model").agg(*[F.sum(c).alias(c) for c in ("dot", "na", "nb")])
    score = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.sqrt("na") * F.sqrt("nb")))
    out = sums.select(key, "model", score.alias("score"), "_e")
    return out.select(key, "model", "score", *verdict(F.col("score"), threshold),
                      F.when(F.col("score").isNull(), F.coalesce("_e", F.lit(ERROR_EMPTY_TEXT))).alias("error"))


def score_dense(pairs: DataFrame, key: str, left: str, right: str,
                models: Iterable[tuple[str, int, int]] | None = None,
                threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Dense vectors per row. ``models`` = (name, start, width) slices of the vectors
    (1-based start); default: one model over the whole vector named ``dense``."""
    a, b = F.col(left), F.col(right)
    parts = [("dense", a, b)] if models is None else [
        (name, F.slice(a, start, width), F.slice(b, start, width)) for name, start, width in models]
    spec = F.array(*[F.struct(F.lit(name).alias("model"), cosine(x, y).alias("score"), vector_error(x, y).alias("error"))
                     for name, x, y in parts])
    out = pairs.select(F.col(key), F.explode(spec).alias("_m")).select(key, "_m.*")
    return out.select(key, "model", "score", *verdict(F.col("score"), threshold),
                      F.when(F.col("score").isNull(), F.col("error")).alias("error"))


def score_pairs(summaries: DataFrame, explanations: DataFrame, key: str = "pair_id",
                models: dict | None = None, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """J8 + M1-M6: summaries ⋈ explanations on the item key, then every lexical model."""
    pairs = summaries.select(key, "summary").join(explanations.select(key, "explanation"), key)
    return score_lexical(pairs, key, "summary", "explanation", models, threshold)


def store_texts(texts: DataFrame, table: str, path: str, key: str = "pair_id", buckets: int = BUCKETS) -> None:
    """``texts`` as a table bucketed and sorted by the key, under ``path``; tables of one bucket count meet without an exchange."""
    # one writing task for each bucket, so a bucket is one file and its order is kept by a scan
    (texts.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))


def score_stored(spark: SparkSession, summaries: str, explanations: str, key: str = "pair_id",
                 models: dict | None = None, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """J8 + M1-M6 over two tables of ``store_texts``: joined and counted bucket by bucket, so whole texts are never shuffled."""
    pairs = spark.table(summaries).select(key, "summary").join(spark.table(explanations).select(key, "explanation").hint("merge"), key)
    return score_lexical(pairs, key, "summary", "explanation", models, threshold, dealt=True)
