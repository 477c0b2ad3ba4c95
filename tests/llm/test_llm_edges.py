"""Empty tables, nulls, repeated rows, clashing column names and long texts, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from patchlens.llm import fingerprints, language, neighbours, packing, pii, quality, secrets, sentencepieces, shards, simhash

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, score double, id long, ids string, spans int, label int, evidence int, block int, shard int"
LONG = "lorem ipsum dolor " * 20_000


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t, 1.0, 7, "x", 3, 1, 2, 4, 5) for i, t in pairs], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "same words in both texts"), (6, "same words in both texts"),
       (None, "no key here at all"), (7, "ünï ©ode ☃ 漢字 \U0001f600"), (8, "x" * 3000), (5, "same words in both texts")]


TAUGHT = [(100 + k, t, lang, q) for k, (t, lang, q) in enumerate([
    ("the cat and the dog were here with them", "en", 1), ("der Hund und die Katze sind nicht hier", "de", 1), ("buy now $$$ click click", "en", 0),
    ("these words are written in plain prose for you", "en", 1), ("$$$ win win click here now $$$", None, 0), ("und das ist ein Satz", "de", 0)] * 8)]


def taught(spark):
    return spark.createDataFrame(TAUGHT, "doc_id long, text string, lang string, quality int")


def op_language(df):
    return language.predict(df, language.fit(taught(df.sparkSession), lambda k: k > 0))


def op_quality(df):
    known = taught(df.sparkSession)
    return quality.score(df, quality.fit(known, known, lambda k: k > 0))


OPS = {
    "sentencepieces": lambda df: sentencepieces.encode(df, PIECES),
    "fingerprints": fingerprints.fingerprints,
    "neighbour_texts": fingerprints.compare_neighbours,
    "packing": lambda df: packing.packed_documents(df, WORDS),
    "pii": pii.find,
    "secrets": lambda df: secrets.find(df, secrets.fit(df)),
    "language": op_language,
    "quality": op_quality,
    "shards": lambda df: shards.shard(df, 3, 16),
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](rows(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_keep_their_keys(spark, name):
    got = [r["doc_id"] for r in OPS[name](rows(spark, *ODD)).collect()]
    if name == "packing":  # one row for each piece
        assert set(got) == {k for k, _ in ODD}
    else:
        assert sorted(got, key=str) == sorted((k for k, _ in ODD), key=str)


def test_search_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0, 3.0]),
         (6, [1.0, 0.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in v], "vec_id long, embedding array<float>, score int")
    got = neighbours.search(df, F.col("vec_id") % 2 == 0, k=5, trees=2, least=10).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got} == {
        (0, 1, 6, 1.0), (0, 2, 8, 0.0), (6, 1, 0, 1.0), (6, 2, 8, 0.0), (8, 1, 0, 0.0), (8, 2, 6, 0.0)}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_fits_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, quality int")
    assert language.fit(empty, lambda k: k > 0).languages == []
    assert quality.fit(empty, empty, lambda k: k > 0).good == b""
    assert set(secrets.fit(empty)) == {0.0}


def test_texts_without_a_letter_have_no_language(spark):
    texts = ["½ ² Ⅷ", "123 ٣ _", "①②③ ㊿", "", None, "\u0301\u0301", "漢", "ª", "Ⅷ und die Katze"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op_language(rows(spark, *enumerate(texts))).collect()}
    assert all(got[k] == ("und", 0.0) for k in range(6))
    assert all(got[k][0] in ("de", "en") for k in (6, 7)) and got[8][0] == "de"


def test_a_backoff_score_by_hand(spark):
    """Every step again in plain Python: counts, smoothed logarithms, the longest known n-grams, the posterior."""
    import math
    from collections import Counter

    docs = [(t, lang) for _, t, lang, _ in TAUGHT if lang]
    count: dict = {}
    for t, lang in docs:
        for w in language.words(t):
            count.setdefault((0, w), Counter())[lang] += 1
            for n in language.ORDERS:
                for g in language.grams(w, n):
                    count.setdefault((n, g), Counter())[lang] += 1
    total = {(n, lang): sum(c[lang] for (m, _), c in count.items() if m == n) for n in range(6) for lang in ("de", "en")}
    log = lambda key, lang: math.log((count[key][lang] + 0.1) / (total[key[0], lang] + 1))
    texts = ["the Katze", "catze undoing", "xyzzy hier", "qqq", "Hunde und dogs"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op_language(rows(spark, *enumerate(texts))).collect()}
    for k, t in enumerate(texts):
        evidence = {"de": 0.0, "en": 0.0}
        for w in language.words(t):
            known = [(0, w)] if (0, w) in count else next((f for n in language.ORDERS if (f := [(n, g) for g in language.grams(w, n) if (n, g) in count])), [])
            for lang in evidence:
                evidence[lang] += sum(log(f, lang) for f in known) / len(known) if known else 0.0
        best = min(evidence, key=lambda lang: (-evidence[lang], lang))
        assert got[k][0] == best and abs(got[k][1] - 1 / sum(math.exp(v - evidence[best]) for v in evidence.values())) < 1e-4


def test_compressed_size_differences_by_hand(spark):
    import zstandard

    model = quality.fit(known := taught(spark), known, lambda k: k > 0)
    texts = ["buy now", "the cat in plain prose", "", "x" * 5000]
    got = {r["doc_id"]: (r["evidence"], r["score"], r["predicted"]) for r in quality.score(rows(spark, *enumerate(texts)), model).collect()}
    for k, t in enumerate(texts):
        size = {}
        for name, raw in (("bad", model.bad), ("good", model.good)):
            packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False,
                                              write_checksum=False, write_dict_id=False)
            data = t.encode()
            size[name] = sum(len(packer.compress(data[i:i + quality.CHUNK])) for i in range(0, len(data), quality.CHUNK))
        want = (size["bad"] - size["good"]) / max(size.values()) if t else 0.0
        assert abs(got[k][0] - want) < 1e-12 and got[k][2] == int(got[k][1] >= 0.7)
