"""The checkout tree as a data source: what is listed, planned, opened, and how items end."""

import os

import pytest
from pyspark.sql import functions as F

from patchlens.plans.analyze import run_tree
from patchlens.sources.tree import PatchItems, _PushingReader, read_sources, resolve_tree, scan_items, store_of, write_files


def put(top, name, text):
    file = top / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)


@pytest.fixture
def tree(tmp_path):
    root, patches = tmp_path / "all_bugs", tmp_path / "projects"
    code = "def f(x):\n    return x\n"
    for project, bug, file, patch in (("p", "1", "a/m.py", "diff --git a/a/m.py b/a/m.py\nindex 1\n"), ("p", "2", "m.py", "diff --git a/n.py b/n.py"),
                                      ("p", "3", "m.py", "index 1\ndiff --git a/m.py b/m.py"), ("p", "4", "m.py", None), ("p", "x5", "m.py", "diff a/m.py b/m.py"),
                                      ("q", "007", "w.py", "diff --git a/w.py b\\w.py b/w.py\r\nmore"), ("q", "8", "m.py", "diff a/x b/../../../../secret.py"),
                                      ("q", "9", "m.py", ""), ("q", "10", "m.py", "diff --git a/m.py b/m.py")):
        put(root, f"{project}/{bug}/buggy/{project}/{file}", code)
        # opening any of these would fail
        os.symlink("/nowhere/at/all", root / project / bug / "buggy" / project / "other.py")
        if patch is not None:
            put(patches, f"{project}/bugs/{bug}/bug_patch.txt", patch)
    put(root, "stray.txt", "no folder")
    put(root, "secret.py", "outside")
    put(root, "p/stray.txt", "no folder")
    return str(root), str(patches)


def test_items_resolve_and_open_one_file_each(spark, tree):
    opened = spark.sparkContext.accumulator(0)
    got = {(r.project, r.bug_id): (r.status, r.buggy_path, r.source) for r in resolve_tree(spark, *tree, items_a_partition=2, opened=opened).collect()}
    code = "def f(x):\n    return x\n"
    assert got == {
        ("p", 1): ("ok", "p/1/buggy/p/a/m.py", code), ("p", 2): ("file_missing", "p/2/buggy/p/n.py", None), ("p", 3): ("no_path", None, None),
        ("p", 4): ("patch_missing", None, None), ("q", 7): ("ok", "q/007/buggy/q/w.py", code),
        ("q", 8): ("file_missing", "q/8/buggy/q/../../../../secret.py", None), ("q", 9): ("no_path", None, None), ("q", 10): ("ok", "q/10/buggy/q/m.py", code)}
    assert opened.value == 3  # the files that items resolve to, of 24


def test_folders_are_dealt_into_partitions(spark, tree):
    assert scan_items(spark, *tree, items_a_partition=3).rdd.getNumPartitions() == 3
    assert scan_items(spark, *tree).rdd.getNumPartitions() == 1


def reader(tree, *conditions):
    r = PatchItems({"root": tree[0], "patches": tree[1], "pushdown": "true"}).reader(None)
    assert isinstance(r, _PushingReader)
    left = list(r.pushFilters(list(conditions)))
    return left, [i for p in r.partitions() for i in p.items]


def test_conditions_cut_folders_off(spark, tree):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringStartsWith
    kept = StringStartsWith(("project",), "p")
    assert reader(tree, EqualTo(("project",), "q"), IsNotNull(("project",)), kept) == ([kept], [("q", "007"), ("q", "10"), ("q", "8"), ("q", "9")])
    assert reader(tree, In(("bug_id",), (1, 7)))[1] == [("p", "1"), ("q", "007")]
    assert reader(tree, GreaterThan(("bug_id",), 3), LessThanOrEqual(("bug_id",), 8))[1] == [("p", "4"), ("q", "007"), ("q", "8")]
    assert reader(tree, EqualTo(("header",), "x"))[0] == [EqualTo(("header",), "x")]


def test_conditions_reach_the_source_from_a_query(spark, tree):
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true"
    q = scan_items(spark, *tree).where("project = 'q' and bug_id in (7, 9) and header like 'diff%'")
    assert [(r.project, r.bug_id, r.folder) for r in q.collect()] == [("q", 7, "007")]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StartsWith") == 1 and "project#" not in plan.split("Filter")[1].split("BatchScan")[0]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert scan_items(spark, *tree).where("project = 'q' and bug_id in (7, 9)").count() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_missing_roots_and_uris(spark, tree, tmp_path):
    assert resolve_tree(spark, str(tmp_path / "none"), tree[1]).count() == 0
    assert resolve_tree(spark, f"file://{tree[0]}", f"file:{tree[1]}").where("status = 'ok'").count() == 3
    assert {r.status for r in resolve_tree(spark, tree[0], str(tmp_path / "none")).collect()} == {"patch_missing"}
    assert store_of("/a/b/")[1] == "/a/b"
    rows = spark.createDataFrame([(None,), ("no/such.py",), ("p/1",)], "buggy_path string")
    assert [r.source for r in read_sources(rows, tree[0]).collect()] == [None, None, None]


def test_from_the_tree_to_results(spark, tree):
    replies = spark.createDataFrame([
        ("p", 1, "def f(x):\n    return x + 1\n---EXPLANATION---\nChange of type return change"), ("q", 7, "no delimiter"), ("p", 2, "NO BUGS FOUND"),
        ("zz", 1, "NO BUGS FOUND")], "project string, bug_id int, reply string")
    out = run_tree(spark, *tree, replies)
    got = {r.pair_id: (r.status, r.error) for r in out["items"].collect()}
    assert got == {"p/1": ("ok", None), "p/2": ("file_missing", "file_missing: p/2/buggy/p/n.py"),
                   "p/3": ("no_path", "no_path: index 1"), "p/4": ("patch_missing", "patch_missing: p/4"), "q/7": ("no_delimiter", None),
                   "q/8": ("file_missing", "file_missing: q/8/buggy/q/../../../../secret.py"), "q/9": ("no_path", "no_path: "), "q/10": ("reply_missing", "reply_missing: q/10")}
    assert {r.pair_id for r in out["scores"].collect()} == {"p/1"}
    assert {(r.pair_id, r.rule) for r in out["changes"].collect()} == {("p/1", "R17"), ("p/1", "R30")}


def test_files_are_written_whole_and_once(spark, tmp_path):
    files = spark.createDataFrame([("a/b.txt", "one\ntwo"), ("c.txt", None)], "path string, text string")
    assert write_files(files, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a/b.txt").read_text() == "one\ntwo" and (tmp_path / "out/c.txt").read_text() == ""
    before = (tmp_path / "out/a/b.txt").stat().st_mtime_ns
    write_files(files.withColumn("text", F.when(F.col("path") == "c.txt", "new").otherwise(F.col("text"))), str(tmp_path / "out"))
    assert (tmp_path / "out/a/b.txt").stat().st_mtime_ns == before and (tmp_path / "out/c.txt").read_text() == "new"
    assert not [f for f in os.listdir(tmp_path / "out/a") if f.endswith(".part")]
