"""Registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import bucket, table
from patchlens.session import ensure_checkpoint_dir


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


def _of_kind(kind: str) -> Callable:
    return lambda span: span["kind"] == kind


def _spans_text(spans):
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from patchlens.llm.sentencepieces import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    return decode(encode(table(spark, sf_dir, "documents"), model), model).select(
        "doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op2_binned_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.fingerprints import compare_neighbours

    def text(name: str):
        return F.lower(F.hex(name)).alias(name)

    return compare_neighbours(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from patchlens.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1)


def op5_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.pii import KINDS, find

    found = find(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])

    return found.select(
        "doc_id", *[F.size(F.filter(plain, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_spans_text(plain), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long").alias("n_disguised"))


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.secrets import KINDS, find, fit

    docs = table(spark, sf_dir, "documents")
    plain = F.filter("spans", lambda s: s["kind"] != "random")
    return find(docs, fit(docs)).select(
        "doc_id", *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_spans_text(plain), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", _of_kind("random"))).cast("long").alias("n_random"))


def op7_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents")
    return (predict(docs, fit(docs, lambda key: bucket(key, 5) != 0))
            .select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda key: bucket(key, 4) != 2)
    return score(docs, model).select(
        "doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed by version 1 of a stored map; ``next_shard`` is the place under version 2, the map edited for one more shard."""
    from patchlens.llm.shards import read_map, shard, slot_totals, store_map, with_next_shard, with_slots

    docs = table(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    placed = shard(docs, 24, path=path)
    edited = store_map(spark, path, slot_totals(with_slots(docs)), 25)
    return with_next_shard(placed, read_map(spark, path, edited)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard")


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.bitslices import search

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` of which every tenth, by its id's checksum, repeats a stretch of its words to the end, as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(
        (h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("words"))
    n = F.size("words")
    planted = words.select("doc_id", "text", "words", n.alias("n"), "g", F.when(n > 0, F.col("g") % n).alias("a"))
    planted = planted.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil(left / F.col("p")).cast("int")))
    body = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), left.cast("int")))
    return planted.select("doc_id", F.when(F.col("n") > 0, F.array_join(body, " ")).otherwise(F.col("text")).alias("text"))


def op12_block_convolution_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.periods import detect

    found = detect(_with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.array_join(F.array(*[r[c].cast("string") for c in ("start", "length", "period")]), ","), F.lit("\n")))
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                         F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
                    F.expr("(-best.less * 1000) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))


def op13_rabin_karp_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchlens.llm.collocations import mine

    return mine(table(spark, sf_dir, "documents"), least=10, best=2000, swallowed=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_lattice": op1_piece_lattice,
    "op2_binned_fingerprints": op2_binned_fingerprints,
    "op3_prefix_forest": op3_prefix_forest,
    "op4_swap_packing": op4_swap_packing,
    "op5_deobfuscated_pii": op5_deobfuscated_pii,
    "op6_markov_secrets": op6_markov_secrets,
    "op7_language_backoff": op7_language_backoff,
    "op8_compression_quality": op8_compression_quality,
    "op9_slot_shards": op9_slot_shards,
    "op10_simhash_pigeonring": op10_simhash_pigeonring,
    "op11_bit_sliced_topk": op11_bit_sliced_topk,
    "op12_block_convolution_runs": op12_block_convolution_runs,
    "op13_rabin_karp_collocations": op13_rabin_karp_collocations,
}
ORACLE: dict[str, str] = {
    "op11_bit_sliced_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256.0::DOUBLE) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op13_rabin_karp_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
f AS (SELECT lang, n, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE n = 1 GROUP BY lang),
cand AS (SELECT lang, n, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE n > 1 AND a >= 10),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE n = 3),
held AS (SELECT lang, phrase, max(a) AS held FROM inside GROUP BY ALL),
kept AS (
  SELECT cand.* FROM cand LEFT JOIN held USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM kept JOIN (SELECT unnest([1, 2]) AS k) ON k < n),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r,
         CAST((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = head JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rest),
low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score
FROM low JOIN total USING (lang) QUALIFY rank <= 2000
""",
}
