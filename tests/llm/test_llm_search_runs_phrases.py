"""Bit-sliced search, periodic runs and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.llm import bitslices, collocations, periods, queries
from patchlens.llm.common import table

SF = "/root/testdata/sf0.001"


# ---- bit-sliced search

def best_of(rows, asked, k):
    """rows: (id, integer vector); {(query id, rank): (id, score)}"""
    out = {}
    for q, v in {(q, tuple(v)): v for q, v in rows if asked(q)}.items():
        points = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in rows if i != q[0] and len(w) == len(v))
        out |= {(q[0], n + 1): (i, -s) for n, (s, i) in enumerate(points[:k])}
    return out


def answers(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6, 7, 171, -1, -5, -256, 1023, -(1 << 31)])
def test_signed_digits(n):
    digits = bitslices.signed_digits(n)
    assert sum(d << place for place, d in digits) == n
    assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))


def test_scores_and_top_of_a_block():
    rng = np.random.default_rng(4)
    values = rng.integers(-40, 60, (150, 9))
    values[:, 3] = 7  # a dimension without a slice
    values[100:130] = values[0]  # ties
    ids = np.arange(0, 300, 2)
    least, widths, slices = bitslices.bit_slices(values)
    block = bitslices.Block(ids, least.tolist(), widths, slices.tobytes())
    for query in (values[5], -values[9], np.zeros(9, int), rng.integers(-5000, 5000, 9)):
        want = {int(i): int(s) for i, s in zip(ids, values @ query) if i != 10}
        for k in (1, 5, 149, 400):
            found, scores = block.top(10, query.tolist(), k)
            best = sorted(want, key=lambda i: (-want[i], i))[:k]
            assert dict(zip(found.tolist(), scores)) == {i: want[i] for i in best}


def test_search_equals_brute_force_over_blocks_and_spans(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(400, 8)).round(1)
    m[50:90] = m[0]
    df = spark.createDataFrame([(int(i), v.tolist(), i % 3) for i, v in enumerate(m)], "vec_id long, embedding array<double>, rank int")
    rows = [(i, np.floor(v * 256).astype(int).tolist()) for i, v in enumerate(m)]
    got = answers(bitslices.search(df, F.col("id") % 10 == 0, 7, block_cells=500, span_queries=9))
    assert got == best_of(rows, lambda q: q % 10 == 0, 7)


def test_search_odd_rows(spark):
    v = [(0, [0.5, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [0.5, 0.0]),
         (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [0.001, -0.001]), (6, [0.5, 0.0]), (10, []), (12, [])]
    df = spark.createDataFrame([(*r, 1.0, 5) for r in v], "vec_id long, embedding array<float>, score double, block int")
    rows = [(0, [128, 0]), (2, [0, 0]), (5, [256, 512, 768]), (6, [128, 0]), (6, [128, 0]), (8, [0, -1]), (10, []), (12, [])]
    assert answers(bitslices.search(df, F.col("id") % 2 == 0)) == best_of(rows, lambda q: q % 2 == 0, 5)
    assert bitslices.search(df.limit(0), F.col("id") % 2 == 0).count() == 0
    wide = spark.createDataFrame([(0, [1e9]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow"):
        bitslices.search(wide, F.col("id") == 0).collect()


# ---- periodic runs

def brute_runs(ws):
    out = set()
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            part = ws[i:j + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.add((i, len(part), q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in out)


def collapse(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(0, periods.PRIME, (5, 64)).astype(np.uint64)
    assert (periods.inverse(periods.transform(x)) == x).all()
    blocks, windows = rng.integers(0, 9, (4, 12)).astype(np.uint64), rng.integers(0, 9, (4, 28)).astype(np.uint64)
    windows[2, 5:17] = blocks[2]
    got = periods.squared_differences(blocks, windows, 32)
    want = [[int(((b - w[q:q + 12]) ** 2).sum()) for q in range(17)] for b, w in zip(blocks.astype(int), windows.astype(int))]
    assert got.tolist() == want and got[2, 5] == 0


def test_runs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "  \n ", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "x " + "a b c " * 40 + "a", "q " * 3000, ("x " * 7 + "y ") * 300]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 7)):
            base = [rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.randint(1, 14))]
            parts += base * rng.randint(1, 7) + base[:rng.randint(0, len(base))]
        texts.append(rng.choice([" ", "\n", " \t", "\x0b "]).join(parts))
    texts += ["ß ü " * 9, "a b " * 8, "a\x1cb " * 8]  # only ASCII white space parts words
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.detect(df).collect()}
    for i, t in enumerate(texts):
        ws = re.findall("[^\x20\x09-\x0d]+", t or "")
        want = brute_runs(ws)
        assert got[i] == (want, collapse(ws, want)), t
    assert periods.detect(df.limit(0)).count() == 0


def test_very_long_texts_are_searched_whole(spark):
    unit = [f"w{i}" for i in range(30_000)]
    text = " ".join(["head", *unit * 4, "w0", "tail"] + ["z"] * 100_000)
    df = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    rows = periods.detect(df).collect()
    assert len(rows) == 2
    for r in rows:
        assert [tuple(x) for x in r["runs"]] == [(1, 120_001, 30_000), (120_003 - 1 + 1, 100_000, 1)]
        assert r["collapsed"] == " ".join(["head", *unit, "tail", "z"])


def test_runs_query_against_the_contract(spark):
    got = {r["doc_id"]: r for r in queries.op12_block_convolution_runs(spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        ws = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(ws)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs, r = brute_runs(ws), got[doc_id]
        planted += bool(runs)
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (
            (len(runs), best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (0, None, None, None, None))
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(ws, runs).encode()).hexdigest()
    assert planted >= 5


# ---- collocations

def brute_phrases(docs, least, best, swallowed):
    count, words = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            ws = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    key = lang, tuple(ws[i:i + n])
                    count[key] = count.get(key, 0) + 1
    out = {}
    frequent = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    held: dict = {}
    for (lang, p), a in frequent.items():
        if len(p) == 3:
            for sub in (p[:2], p[1:]):
                held[lang, sub] = max(held.get((lang, sub), 0), a)
    for (lang, p), a in frequent.items():
        if 100 * held.get((lang, p), -1) >= swallowed * a:
            continue
        cuts = [(1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1): (p.decode(), -a, left, right, words[lang], -s)
            for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best])}


def phrases(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def test_phrases_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "New", "york", "of", "zürich", "ÄB", "a", "b", "c", "\U0001f600", "x y", "￿"]
    docs = [(rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"])
                                                    for _ in range(rng.randint(0, 80)))) for _ in range(150)]
    docs += [("en", None), ("en", ""), (None, " ,. "), ("", "a b " * 20), ("en", "same words here again " * 3)] + [("en", "same words here again")] * 12
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, block int, phrase string").repartition(5)
    for sizes in ({}, {"flush_words": 300, "bucket_entries": 500, "block_bytes": 700, "filter_bits": 1 << 12}):
        for best in (2000, 4):
            assert phrases(collocations.mine(df, 3, best, 50, **sizes)) == brute_phrases(docs, 3, best, 50)
    assert collocations.mine(df.limit(0)).count() == 0
    assert collocations.mine(df.where("text = ''")).count() == 0


def test_phrases_of_a_very_long_text(spark):
    text = "alpha beta gamma, " * 60_000
    df = spark.createDataFrame([("en", text), ("en", "alpha beta. ")], "lang string, text string")
    assert phrases(collocations.mine(df, flush_words=10_000)) == brute_phrases([("en", text), ("en", "alpha beta. ")], 10, 2000, 50)


def test_scores_beyond_64_bits(spark):
    counts = {"a": 9 * 10**12, "b": 8 * 10**12, "a b": 7 * 10**12 + 1}
    df = spark.createDataFrame([(c,) for c in counts.values()], "x long")
    wide = F.col("x").cast("decimal(15,0)")
    got = [r[0] for r in df.select(F.call_function("div", F.lit(10**6).cast("decimal(7,0)") * (wide * wide), (wide + 3) * (wide + 2))).collect()]
    assert got == [10**6 * c * c // ((c + 3) * (c + 2)) for c in counts.values()]


def test_collisions_within_a_flush_are_told_apart():
    held = collocations.Held()
    held.add("en", b"one two. one two. uno dos. one dos")
    for w in (b"uno", b"dos"):  # made to collide with "one" and "two"
        held.numbers.hashes[held.numbers[w]] = held.numbers.hashes[held.numbers[{b"uno": b"one", b"dos": b"two"}[w]]]
    prints, at, counts, totals = held.counted()
    assert totals == {"en": 8}
    names = {v: k for k, v in held.numbers.items()}
    flat = [names[i] for part in held.parts for i in part.tolist()]
    found = {tuple(flat[i:i + int(f & np.uint64(3))]): int(c) for f, i, c in zip(prints, at, counts)}
    assert found == {(b"one",): 3, (b"two",): 2, (b"uno",): 1, (b"dos",): 2, (b"one", b"two"): 2, (b"uno", b"dos"): 1, (b"one", b"dos"): 1}


def test_collisions_between_tasks_come_apart(spark):
    a, b = b"red fox", b"old owl"
    bodies = collocations._bodies(spark.createDataFrame([("en", a.decode()), ("en", b.decode())], "lang string, text string"), 1)
    same = 77 << 2 | 2  # one fingerprint for both phrases
    shares = np.array([(collocations.text_hash("en", t), same, 0, n) for t, n in ((a, 6), (b, 5))], collocations._SHARE)
    assert collocations.mark_of(1 << 47 | 3) == int(collocations.mark_of(np.array([1 << 47 | 3], np.uint64))[0]) == 1 << 29 | 3
    df = spark.createDataFrame([(0, bytearray(collocations.squeezed(shares)), None, None)], "block int, shares binary, lang string, words long")
    got = {(r["lang"], r["n"], r["phrase"], r["count"]) for r in collocations._spelled(df, bodies).collect()}
    assert got == {("en", 2, "red fox", 6), ("en", 2, "old owl", 5)}


@pytest.mark.parametrize("kind", ["<u8", "<u4", collocations._SHARE])
def test_squeezed_arrays_come_back(kind):
    for n in (0, 1, 1000):
        a = np.random.default_rng(n).integers(0, 256, n * np.dtype(kind).itemsize).astype(np.uint8).view(kind)
        assert (collocations.expanded(collocations.squeezed(a), kind) == a).all()


def test_filter_never_misses():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << collocations.PRINT_BITS, 5000, dtype=np.uint64)
    bits = np.zeros(1 << 16, np.uint8)
    bits[collocations.Filter.places(prints[:2000], 1 << 16)] = 1
    held = collocations.Filter(np.packbits(bits, bitorder="little")).holds(prints)
    assert held[:2000].all() and held[2000:].mean() < 0.02


def test_texts_of_one_hash_keep_their_own_shares(spark):
    """Two texts made to share a hash: every share is read from the text that gives its fingerprint."""
    bodies = collocations._bodies(spark.createDataFrame([("en", "red fox"), ("en", "old owl")], "lang string, text string"), 1).withColumn("text", F.lit(5).cast("long"))
    phrases = ((b"red", b"fox"), (b"old", b"owl"), (b"red",))
    shares = np.array([(5, collocations.mark_of(collocations.fingerprint("en", list(p))), 0, n) for n, p in enumerate(phrases, 1)], collocations._SHARE)
    df = spark.createDataFrame([(0, bytearray(collocations.squeezed(shares)), None, None)], "block int, shares binary, lang string, words long")
    assert {(r["phrase"], r["count"]) for r in collocations._spelled(df, bodies).collect()} == {("red fox", 1), ("old owl", 2), ("red", 3)}


def test_fingerprints_of_the_flush_are_those_of_the_phrase():
    held = collocations.Held()
    held.add("fr", "le Petit prince; ürsprung".encode())
    prints, at, _, _ = held.counted()
    names = {v: k for k, v in held.numbers.items()}
    flat = [names[i] for part in held.parts for i in part.tolist()]
    for f, i in zip(prints.tolist(), at.tolist()):
        assert collocations.fingerprint("fr", flat[i:i + (f & 3)]) == f
