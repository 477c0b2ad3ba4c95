"""Manifest, corpus keys, item resolution, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PY_WS_CLASS, first_line
from ..schemas import STATUS_FILE_MISSING, STATUS_NO_PATH, STATUS_OK, STATUS_PATCH_MISSING

# ---- fixed values: the benchmark manifest (project -> number of bugs)
PROJECT_BUGS = {
    "pysnooper": 3, "ansible": 18, "black": 23, "cookiecutter": 4, "fastapi": 16,
    "httpie": 5, "keras": 45, "luigi": 33, "matplotlib": 30, "pandas": 169,
    "sanic": 5, "scrapy": 40, "spacy": 10, "thefuck": 32, "tornado": 16,
    "tqdm": 9, "youtube-dl": 43,
}
VERSION_LABELS = ((0, "buggy"), (1, "fixed"))
# ---- end of fixed values

# <root>/<project>/<bug id>/<buggy|fixed>/<relative path>; bug folders are digits only
CORPUS_PATH = r"^(.*?)/?([^/]+)/([0-9]+)/(buggy|fixed)/(.+)$"


def manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PROJECT_BUGS.items()), "project string, n_bugs int")


def expand_bugs(projects: DataFrame, project: str = "project", n_bugs: str = "n_bugs") -> DataFrame:
    """One row per (project, bug_id) with ids 1..n (no rows when n < 1)."""
    n = F.col(n_bugs)
    return projects.select(
        F.col(project).alias("project"),
        F.explode(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")))
        .alias("bug_id"))


def expand_manifest(projects: DataFrame, root: str = "", project: str = "project", n_bugs: str = "n_bugs") -> DataFrame:
    """S1 + P1: (project, bug_id, version, label, path), two checkouts per bug."""
    versions = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(lab).alias("label")) for v, lab in VERSION_LABELS])
    bugs = expand_bugs(projects, project, n_bugs)
    out = bugs.select("project", "bug_id", F.explode(versions).alias("_v"))
    parts = ([F.lit(root)] if root else []) + [F.col("project"), F.col("bug_id").cast("string"), F.col("_v.label")]
    return out.select("project", "bug_id", F.col("_v.version").alias("version"), F.col("_v.label").alias("label"),
                      F.concat_ws("/", *parts).alias("path"))


def corpus_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """(project, bug_id, label, rel_path) from corpus file paths; paths outside
    the <project>/<digits>/<buggy|fixed>/ layout are skipped."""
    p = F.translate(F.col(path), "\\", "/")
    ok = p.rlike(CORPUS_PATH)
    keep = [c for c in files.columns if c not in (path, "project", "bug_id", "label", "rel_path")]
    return (files.where(ok).select(
        F.col(path).alias("path"), *keep,
        F.regexp_extract(p, CORPUS_PATH, 2).alias("project"),
        F.regexp_extract(p, CORPUS_PATH, 3).cast("bigint").alias("bug_id"),
        F.regexp_extract(p, CORPUS_PATH, 4).alias("label"),
        F.regexp_extract(p, CORPUS_PATH, 5).alias("rel_path")))


def list_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, project, bug_id, label, rel_path) of the files under a checkout root. Only the listing
    is used, no file is opened: enough to resolve items before any source is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return corpus_keys(files.select(F.regexp_replace("path", "^file:/*", "/").alias("path")))


def scan_corpus(spark: SparkSession, glob: str) -> DataFrame:
    """Whole files under a checkout root -> (path, project, bug_id, label, rel_path, source)."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(glob, wholetext=True)
           .select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"),
                   F.col("value").alias("source")))
    return corpus_keys(raw)


def patch_path(header: F.Column) -> F.Column:
    """Modified file from the first line of a diff: first whitespace token that
    starts with ``b/``, minus the prefix, separators unified; null unless the line starts
    with ``diff`` or when no usable token exists."""
    toks = F.split(F.regexp_replace(header, rf"\A{PY_WS_CLASS}+|{PY_WS_CLASS}+\z", ""), PY_WS_CLASS + "+")
    hit = F.try_element_at(F.filter(toks, lambda t: t.startswith("b/")), F.lit(1))
    rel = F.substring(hit, 3, 1 << 30)
    rel = F.when(header.startswith("diff") & (F.length(rel) > 0), rel)
    return F.translate(rel, "\\", "/")


def resolve_items(items: DataFrame, patches: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(project, bug_id, rel_path, buggy_path, status, error).

    First failing check names the outcome: patch missing, no path in its first line,
    buggy file missing; ``error`` says what was looked at. ``patches``: (project, bug_id, patch),
    of several for one item the one with the smallest first line; ``files``: (path, ...). Only
    items with a path meet the files, so no null key gathers in one task.
    """
    p = (patches.select("project", "bug_id", F.coalesce(first_line(F.col("patch")), F.lit("")).alias("_header"))
         .groupBy("project", "bug_id").agg(F.min("_header").alias("_header"), F.lit(True).alias("_has_patch")))
    j = items.select("project", "bug_id").join(p, ["project", "bug_id"], "left")
    rel = patch_path(F.col("_header"))
    parts = ([F.lit(root)] if root else []) + [F.col("project"), F.col("bug_id").cast("string"), F.lit("buggy"),
                                               F.col("project"), F.col("rel_path")]
    j = j.withColumn("rel_path", F.when(F.col("_has_patch"), rel))
    j = j.withColumn("buggy_path", F.when(F.col("rel_path").isNotNull(), F.concat_ws("/", *parts)))
    f = files.select(F.col("path").alias("buggy_path")).where(F.col("buggy_path").isNotNull()).distinct().withColumn("_has_file", F.lit(True))
    found = j.where(F.col("buggy_path").isNotNull()).join(f, "buggy_path", "left")
    j = found.unionByName(j.where(F.col("buggy_path").isNull()).withColumn("_has_file", F.lit(None).cast("boolean")))
    status = (F.when(F.col("_has_patch").isNull(), F.lit(STATUS_PATCH_MISSING))
              .when(F.col("rel_path").isNull(), F.lit(STATUS_NO_PATH))
              .when(F.col("_has_file").isNull(), F.lit(STATUS_FILE_MISSING))
              .otherwise(F.lit(STATUS_OK)))
    seen = F.coalesce("buggy_path", "_header", F.concat_ws("/", "project", F.col("bug_id").cast("string")))
    return (j.withColumn("status", status).select(
        "project", "bug_id", "rel_path", "buggy_path", "status",
        F.when(F.col("status") != STATUS_OK, F.concat(F.col("status"), F.lit(": "), seen)).alias("error")))


def status_counts(items: DataFrame) -> DataFrame:
    """(project, status, n)."""
    return items.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n"))
