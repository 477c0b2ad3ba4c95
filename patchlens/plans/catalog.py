"""Registered queries over the driver tables, and their DuckDB oracles.

Every query reads whole tables through the views in ``views.py`` and runs the engine's
operators on them. Oracles re-derive the same result in SQL, independently of the
engine code. Output columns are scalars with matching names and widths on both sides.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..operators.align import align_functions, diff_reordered, diff_tail, last_wins, pair_functions
from ..operators.encoder import encode, fit_hashed_idf
from ..operators.extract import extract_functions
from ..operators.render import item_texts, render_changes
from ..operators.rules import diff_nodes
from ..operators.similarity import LEXICAL_MODELS, score_dense, score_lexical, score_pairs, score_stored, store_texts
from ..schemas import NODE, PHASE_EXPRESSION
from ..sources.changes_io import read_changes
from ..sources.items import (corpus_keys, expand_bugs, expand_manifest, patch_path, resolve_items,
                             status_counts)
from ..sources.replies import build_versions, parse_replies, render_requests
from ..sources.tree import PATCH_FILE, PATCH_FOLDER, resolve_tree, write_files
from ..functions.text import first_line
from ..session import ensure_checkpoint_dir
from .analyze import analyze_pairs, run_tree
from .flagship import flagship, lines_by_order
from . import views as V

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def _view(spark, sf_dir, sql, *tables) -> DataFrame:
    register(spark, sf_dir, *tables)
    return spark.sql(sql)


# ------------------------------------------------------------------ node views -> NODE

def _list(c: Column) -> Column:
    """A ``;``-joined list of texts that are not empty; reads ``c`` once, so that its expression is computed where it is split."""
    return F.filter(F.split(c, ";"), lambda x: x != "")


def view_node(prefix: str) -> dict[str, Column]:
    """The column of each NODE field, from the view's columns of one side."""
    fields = {}
    for f in NODE.fields:
        c = F.col(f"{prefix}_{f.name}") if f.name != "orelse_texts" else F.lit(None)
        fields[f.name] = (_list(c) if f.name in V.LIST_FIELDS else c).cast(f.dataType)
    return fields


def _node_changes_of(spark, sf_dir, family, mode: str = "reference") -> DataFrame:
    """Change records of a family's statement slots, the nodes made of the view's columns as the rules read them. Rows are dealt by the
    view's functions as they are read: its window would shuffle them only after its twenty columns are made."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.repartition("l_orderkey", F.expr("l_linenumber % 2")).createOrReplaceTempView("lineitem")
    v = spark.sql(V.node_pairs_sql(family))
    return diff_nodes(v, mode, view_node("o"), view_node("n"), keys=["pair_id", "func", "first_ord", "pos"])


def _joined(c: str) -> Column:
    return F.array_join(F.col(c), ";")


DIFF_COLS = ("pair_id", "func", "pos", "seq", "rule", "type", "function", "target", "cls", "module", "old", "new",
             "old_list", "new_list", "cond", "body")


def _diff_out(ch: DataFrame) -> DataFrame:
    return ch.select("pair_id", "func", F.col("pos").cast("bigint").alias("pos"), F.col("seq").cast("bigint").alias("seq"),
                     "rule", "type", "function", "target", F.col("class").alias("cls"), "module", "old", "new",
                     _joined("old_list").alias("old_list"), _joined("new_list").alias("new_list"),
                     F.col("condition").alias("cond"), _joined("body").alias("body"))


def q_diff(family):
    def run(spark, sf_dir):
        return _diff_out(_node_changes_of(spark, sf_dir, family))
    return run


def _node_changes(spark, sf_dir):
    return _node_changes_of(spark, sf_dir, "all").withColumn("phase", F.lit(0))


def q_changes_json(spark, sf_dir):
    t = item_texts(_node_changes(spark, sf_dir))
    return t.select("pair_id", F.col("n_functions").cast("bigint").alias("n_functions"),
                    F.col("n_changes").cast("bigint").alias("n_changes"), "changes_json")


def q_changes_roundtrip(spark, sf_dir):
    t = item_texts(_node_changes(spark, sf_dir))
    r = read_changes(t)
    text = lambda f: F.coalesce(f, F.to_json(f"{f}_list")).alias(f)
    return r.select("pair_id", "func", F.col("pos").cast("bigint").alias("idx"), "type", text("old"), text("new"),
                    "function", "target")


def q_summary_from_json(spark, sf_dir):
    """Stored change sets rendered: rows -> JSON -> rows -> summary."""
    stored = item_texts(_node_changes(spark, sf_dir)).select("pair_id", "changes_json")
    return item_texts(read_changes(stored)).select("pair_id", "summary")


def q_diff_strict(spark, sf_dir):
    """Strict mode over nodes of every family: else texts compared, decorators of functions too."""
    return _diff_out(_node_changes_of(spark, sf_dir, "all", "strict"))


def q_diff_expressions(spark, sf_dir):
    """Records of the expressions inside aligned statements, from both versions' source texts (mode ``extended``)."""
    lines_by_order(spark, sf_dir)
    ch = analyze_pairs(spark.sql(V.expression_items_sql("spark")), "extended").where(F.col("phase") == PHASE_EXPRESSION)
    text = lambda c: F.coalesce(F.col(c), _joined(f"{c}_list")).alias(c)
    return ch.select("pair_id", "func", F.col("pos").cast("bigint").alias("pos"), F.col("seq").cast("bigint").alias("seq"), "rule", "type",
                     text("old"), text("new"))


def q_render_all_types(spark, sf_dir):
    """Sentences of every template, the reordered, added and unknown ones too, over whole ``lineitem``."""
    v = _view(spark, sf_dir, V.stored_records_sql(), "lineitem")
    return render_changes(v).select("id", "type", "sentence")


def q_render_sentences(spark, sf_dir):
    r = render_changes(_node_changes(spark, sf_dir))
    return r.select("pair_id", "func", F.col("pos").cast("bigint").alias("pos"),
                    F.col("seq").cast("bigint").alias("seq"), "type", "sentence")


def q_summary_text(spark, sf_dir):
    return item_texts(_node_changes(spark, sf_dir)).select("pair_id", "summary")


# ------------------------------------------------------------------ functions

def _functions(spark, sf_dir):
    return _view(spark, sf_dir, V.functions_sql(), "orders")


def q_functions_last_wins(spark, sf_dir):
    lw = last_wins(_functions(spark, sf_dir))
    return lw.select("pair_id", F.col("version").cast("bigint").alias("version"), "func", "body",
                     F.col("walk_ord").cast("bigint").alias("walk_ord"),
                     F.col("first_ord").cast("bigint").alias("first_ord"))


def q_functions_join(spark, sf_dir):
    p = pair_functions(_functions(spark, sf_dir), payload="body")
    return p.select("pair_id", "func", F.col("first_ord").cast("bigint").alias("first_ord"),
                    F.col("old_walk").cast("bigint").alias("old_walk"),
                    F.col("new_walk").cast("bigint").alias("new_walk"), "old_body", "new_body")


def _sources(spark, sf_dir):
    return _view(spark, sf_dir, V.sources_sql("spark"), "lineitem")


def _extracted(src: DataFrame, partitions: int | None = None) -> DataFrame:
    f = extract_functions(src.select("pair_id", F.lit(0).alias("version"), "source"), partitions)
    return f.select("pair_id", "func", F.col("walk_ord").cast("bigint").alias("walk_ord"),
                    F.array_join("args", ",").alias("args"),
                    F.size("stmts").cast("bigint").alias("n_stmts"),
                    F.array_join(F.transform("stmts", lambda x: x["kind"]), ",").alias("kinds"),
                    F.array_join(F.transform("stmts", lambda x: x["text"]), "|").alias("texts"),
                    F.regexp_extract("error", r"^(\w+)", 1).alias("error_kind"))


def q_extract_functions(spark, sf_dir):
    return _extracted(_sources(spark, sf_dir))


def q_extract_odd_functions(spark, sf_dir):
    """Plain definitions in non-canonical files: parameters of every kind, ``async def`` skipped but not what it holds. A row of
    ``part`` is a few bytes and the file made of it hundreds, so splits by bytes would leave the parsing to a task or two."""
    return _extracted(_view(spark, sf_dir, V.odd_sources_sql(), "part"), 4 * spark.sparkContext.defaultParallelism)


# ------------------------------------------------------------------ text pairs (statement = line)

def _line_nodes(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.transform(lines, lambda ln: F.struct(*[
        (F.when(ln.contains(","), F.lit("If")).otherwise(F.lit("Expr")) if f.name == "kind"
         else ln if f.name == "text"
         else F.when(ln.contains(","), ln) if f.name == "test"
         else F.when(ln.contains(","), F.array(ln)) if f.name == "body_texts"
         else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields]))


def _doc_pairs(spark, sf_dir):
    d = _view(spark, sf_dir, V.doc_pairs_sql(), "documents")
    return d.select("pair_id", F.lit("doc").alias("func"), _line_nodes(F.col("old_text")).alias("old_stmts"),
                    _line_nodes(F.col("new_text")).alias("new_stmts"))


def q_align_positions(spark, sf_dir):
    a = align_functions(_doc_pairs(spark, sf_dir))
    return a.select("pair_id", F.col("pos").cast("bigint").alias("pos"), F.col("old.text").alias("old_line"),
                    F.col("new.text").alias("new_line"))


def q_added_tail(spark, sf_dir):
    t = diff_tail(align_functions(_doc_pairs(spark, sf_dir)))
    return t.select("pair_id", F.col("pos").cast("bigint").alias("pos"), "rule", "type",
                    F.col("condition").alias("cond"), _joined("body").alias("body"), "function")


def q_reordered(spark, sf_dir):
    r = diff_reordered(_doc_pairs(spark, sf_dir))
    return r.select("pair_id", F.col("seq").cast("bigint").alias("seq"), "statement",
                    F.col("old_position").cast("bigint").alias("old_position"),
                    F.col("new_position").cast("bigint").alias("new_position"))


# ------------------------------------------------------------------ scoring

def _score_out(df):
    return df.select("pair_id", "model", F.round("score", 4).alias("score"), "shown", "is_match", "error")


def q_score_lexical(spark, sf_dir):
    p = _view(spark, sf_dir, V.text_pairs_sql(), "documents")
    return _score_out(score_lexical(p, "pair_id", "summary", "explanation", LEXICAL_MODELS))


def q_score_pairs(spark, sf_dir):
    """Whole documents as summaries, all turns of a conversation, in order, as explanations."""
    register(spark, sf_dir, "documents", "conversations")
    return _score_out(score_pairs(spark.sql(V.document_summaries_sql()), spark.sql(V.conversation_explanations_sql("spark")), "pair_id"))


def q_score_stored_pairs(spark, sf_dir):
    """J8 from co-located storage: whole documents and whole conversations as bucketed tables, scored without a shuffle."""
    register(spark, sf_dir, "documents", "conversations")
    top, mark = ensure_checkpoint_dir(spark).rstrip("/"), f"{zlib.crc32(sf_dir.encode()):08x}"
    names = f"summaries_{mark}", f"explanations_{mark}"
    for name, sql in zip(names, (V.document_summaries_sql(), V.conversation_explanations_sql("spark"))):
        store_texts(spark.sql(sql), name, f"{top}/tables-{spark.sparkContext.applicationId}/{name}")
    return _score_out(score_stored(spark, *names))


def _document_frequencies(spark, sf_dir):
    return fit_hashed_idf(_view(spark, sf_dir, "SELECT text FROM documents", "documents"))


def q_encode_hashed(spark, sf_dir):
    """M1: whole documents as sparse vectors of a fitted fixed-width encoder."""
    d = _view(spark, sf_dir, "SELECT doc_id, text FROM documents", "documents")
    v = encode(d, _document_frequencies(spark, sf_dir))
    norm = F.sqrt(F.aggregate("vector.values", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("doc_id", F.size("vector.indices").cast("bigint").alias("n_indices"),
                    F.md5(F.array_join("vector.indices", ",").cast("binary")).alias("indices_md5"), F.round(norm, 4).alias("norm"))


def q_score_hashed_idf(spark, sf_dir):
    """Neighbouring documents scored by the fitted encoder, in the place of a sentence encoder."""
    p = _view(spark, sf_dir, V.text_pairs_sql(), "documents")
    return _score_out(score_lexical(p, "pair_id", "summary", "explanation", {"hashed_idf": _document_frequencies(spark, sf_dir)}))


def q_score_dense(spark, sf_dir):
    p = _view(spark, sf_dir, V.vector_pairs_sql(), "embeddings")
    return _score_out(score_dense(p, "pair_id", "left_vec", "right_vec"))


def q_score_models(spark, sf_dir):
    p = _view(spark, sf_dir, V.vector_pairs_sql(), "embeddings")
    return _score_out(score_dense(p, "pair_id", "left_vec", "right_vec", V.VECTOR_MODELS))


def q_text_normalise(spark, sf_dir):
    c = _view(spark, sf_dir, "SELECT * FROM conversations", "conversations")
    return c.select("conv_id", "turn", normalise(F.col("text")).alias("norm"))


# ------------------------------------------------------------------ replies

def _replies(spark, sf_dir):
    return _view(spark, sf_dir, V.replies_sql(), "conversations")


def q_request_text(spark, sf_dir):
    d = _view(spark, sf_dir, "SELECT doc_id, text FROM documents", "documents")
    return render_requests(d, "text").select("doc_id", "request")


def q_reply_parse(spark, sf_dir):
    return parse_replies(_replies(spark, sf_dir)).select("pair_id", "status", "fixed", "explanation")


def q_reply_clean(spark, sf_dir):
    from ..functions.text import clean_code_block
    r = _replies(spark, sf_dir)
    return r.select("pair_id", clean_code_block(F.col("reply")).alias("cleaned"))


def q_versions_union(spark, sf_dir):
    parsed = parse_replies(_replies(spark, sf_dir)).where(F.col("fixed").isNotNull())
    v = build_versions(_replies(spark, sf_dir), parsed)
    return v.select("pair_id", F.col("version").cast("bigint").alias("version"), "source")


# ------------------------------------------------------------------ items

def q_manifest_expand(spark, sf_dir):
    b = expand_bugs(_view(spark, sf_dir, V.projects_sql(), "part"))
    return b.select("project", F.col("bug_id").cast("bigint").alias("bug_id"))


def q_manifest_versions(spark, sf_dir):
    m = expand_manifest(_view(spark, sf_dir, V.projects_sql(), "part"), root="all_bugs")
    return m.select("project", F.col("bug_id").cast("bigint").alias("bug_id"),
                    F.col("version").cast("bigint").alias("version"), "label", "path")


def q_corpus_keys(spark, sf_dir):
    files = _view(spark, sf_dir, V.files_sql() + " UNION ALL SELECT url AS path, html AS source FROM pages", "pages")
    k = corpus_keys(files)
    return k.select("path", "project", F.col("bug_id").cast("bigint").alias("bug_id"), "label", "rel_path")


def q_patch_path(spark, sf_dir):
    p = _view(spark, sf_dir, V.patches_sql(), "pages")
    return p.select("project", F.col("bug_id").cast("bigint").alias("bug_id"),
                    patch_path(first_line(F.col("patch"))).alias("rel_path"))


def _resolved(spark, sf_dir):
    register(spark, sf_dir, "part", "pages")
    return resolve_items(spark.sql(V.items_sql()), spark.sql(V.patches_sql()), spark.sql(V.files_sql()))


def q_item_status(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return r.select("project", F.col("bug_id").cast("bigint").alias("bug_id"), "rel_path", "buggy_path", "status", "error")


def q_status_counts(spark, sf_dir):
    c = status_counts(_resolved(spark, sf_dir))
    return c.select("project", "status", F.col("n").cast("bigint").alias("n"))


def _checkout_tree(spark, sf_dir) -> tuple[str, str]:
    """(root, patches) of a checkout tree written from ``pages`` to the shared folder."""
    register(spark, sf_dir, "pages")
    top = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode()):08x}"
    patches = spark.sql(V.tree_patches_sql("spark")).select(
        F.concat_ws("/", "project", F.lit(PATCH_FOLDER), F.col("bug_id").cast("string"), F.lit(PATCH_FILE)).alias("path"), F.col("patch").alias("text"))
    write_files(spark.sql(V.tree_files_sql("spark")), f"{top}/all_bugs")
    write_files(patches, f"{top}/projects")
    return f"{top}/all_bugs", f"{top}/projects"


def q_tree_items(spark, sf_dir):
    """Items of a checkout tree on disk: listed, resolved through their diffs and read, in one plan over files."""
    r = resolve_tree(spark, *_checkout_tree(spark, sf_dir))
    return r.select("project", "bug_id", "rel_path", "buggy_path", "status", "error", F.md5(F.col("source").cast("binary")).alias("source_md5"))


def q_tree_outcomes(spark, sf_dir):
    """From the tree on disk to one outcome and summary an item, from ``patch_missing`` to ``parse_error``."""
    root, patches = _checkout_tree(spark, sf_dir)
    items = run_tree(spark, root, patches, spark.sql(V.tree_replies_sql("spark")))["items"]
    error = F.when(F.col("status") == "parse_error", F.regexp_extract("error", r"^(\w+)", 1)).otherwise(F.col("error"))
    return items.select("pair_id", "status", F.col("n_functions").cast("bigint").alias("n_functions"),
                        F.col("n_changes").cast("bigint").alias("n_changes"), "summary", error.alias("error"))


QUERIES = {
    "manifest_expand": q_manifest_expand,
    "manifest_versions": q_manifest_versions,
    "corpus_keys": q_corpus_keys,
    "patch_path": q_patch_path,
    "item_status": q_item_status,
    "status_counts": q_status_counts,
    "tree_items": q_tree_items,
    "tree_outcomes": q_tree_outcomes,
    "versions_union": q_versions_union,
    "request_text": q_request_text,
    "reply_parse": q_reply_parse,
    "reply_clean": q_reply_clean,
    "text_normalise": q_text_normalise,
    "extract_functions": q_extract_functions,
    "extract_odd_functions": q_extract_odd_functions,
    "functions_last_wins": q_functions_last_wins,
    "functions_join": q_functions_join,
    "align_positions": q_align_positions,
    "added_tail": q_added_tail,
    "reordered": q_reordered,
    "diff_conditions": q_diff("conditions"),
    "diff_loops": q_diff("loops"),
    "diff_assign": q_diff("assign"),
    "diff_functions": q_diff("functions"),
    "diff_imports": q_diff("imports"),
    "diff_exceptions": q_diff("exceptions"),
    "diff_classes": q_diff("classes"),
    "diff_literals": q_diff("literals"),
    "diff_returns": q_diff("returns"),
    "diff_calls": q_diff("calls"),
    "diff_docstrings": q_diff("docstrings"),
    "diff_attributes": q_diff("attributes"),
    "changes_json": q_changes_json,
    "changes_roundtrip": q_changes_roundtrip,
    "render_sentences": q_render_sentences,
    "summary_text": q_summary_text,
    "summary_from_json": q_summary_from_json,
    "diff_strict": q_diff_strict,
    "diff_expressions": q_diff_expressions,
    "render_all_types": q_render_all_types,
    "score_pairs": q_score_pairs,
    "score_lexical": q_score_lexical,
    "score_stored_pairs": q_score_stored_pairs,
    "encode_hashed": q_encode_hashed,
    "score_hashed_idf": q_score_hashed_idf,
    "score_dense": q_score_dense,
    "score_models": q_score_models,
}


def q_end_to_end(spark, sf_dir):
    return flagship(spark, sf_dir)


QUERIES["end_to_end"] = q_end_to_end
