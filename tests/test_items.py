from pyspark.sql import functions as F


def test_patch_path(spark):
    from patchlens.functions.text import first_line
    from patchlens.sources.items import patch_path
    heads = ["diff --git a/x/y.py b/x/y.py\nindex 1", "index 1\ndiff --git a/x b/x", "diff --git a/x.py b/",
             "diff --git a/p.py b/p.py b/q.py", "diff --git a/z b/z\\w.py", "  diff --git a/x b/x", "diff a/x\tb/t.py\r\nmore"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    got = [r.p for r in df.orderBy("i").select(patch_path(first_line(F.col("h"))).alias("p")).collect()]
    assert got == ["x/y.py", None, None, "p.py", "z/w.py", None, "t.py"]


def test_resolve_cascade_and_counts(spark):
    from patchlens.sources.items import resolve_items, status_counts
    items = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("p", 4)], "project string, bug_id int")
    patches = spark.createDataFrame([("p", 2, "index x"), ("p", 3, "diff a/f.py b/f.py"), ("p", 4, "diff a/g.py b/g.py")],
                                    "project string, bug_id int, patch string")
    files = spark.createDataFrame([("p/4/buggy/p/g.py",)], "path string")
    r = resolve_items(items, patches, files)
    assert {(x.bug_id, x.status) for x in r.collect()} == {(1, "patch_missing"), (2, "no_path"),
                                                           (3, "file_missing"), (4, "ok")}
    assert {(x.status, x.n) for x in status_counts(r).collect()} == {
        ("patch_missing", 1), ("no_path", 1), ("file_missing", 1), ("ok", 1)}


def test_manifest(spark):
    from patchlens.sources.items import PROJECT_BUGS, expand_manifest, manifest
    m = expand_manifest(manifest(spark), root="all_bugs")
    assert m.count() == 2 * sum(PROJECT_BUGS.values()) == 1002
    row = m.where("project = 'tqdm' and bug_id = 9 and version = 1").first()
    assert (row.label, row.path) == ("fixed", "all_bugs/tqdm/9/fixed")
    zero = spark.createDataFrame([("z", 0), ("n", -1)], "project string, n_bugs int")
    assert expand_manifest(zero).count() == 0


def test_corpus_keys_and_scan(spark, tmp_path):
    from patchlens.sources.items import scan_corpus
    root = tmp_path / "all_bugs"
    (root / "proj" / "7" / "buggy" / "proj" / "pkg").mkdir(parents=True)
    (root / "proj" / "7" / "buggy" / "proj" / "pkg" / "m.py").write_text("def f():\n    return 1\n")
    (root / "proj" / "notes").mkdir(parents=True)
    (root / "proj" / "notes" / "x.py").write_text("skip me")
    rows = scan_corpus(spark, str(root)).collect()
    assert [(r.project, r.bug_id, r.label, r.rel_path) for r in rows] == [("proj", 7, "buggy", "proj/pkg/m.py")]
    assert rows[0].source.startswith("def f()")
    from patchlens.sources.items import list_corpus, resolve_items
    listed = list_corpus(spark, str(root))
    assert [r.path for r in listed.collect()] == [r.path for r in rows]
    items = spark.createDataFrame([("proj", 7), ("proj", 8)], "project string, bug_id int")
    patches = spark.createDataFrame([("proj", 7, "diff a/x b/pkg/m.py"), ("proj", 7, "diff a/x b/pkg/m.py\nmore")],
                                    "project string, bug_id int, patch string")
    got = {r.bug_id: (r.status, r.error) for r in resolve_items(items, patches, listed, str(root)).collect()}
    assert got == {7: ("ok", None), 8: ("patch_missing", "patch_missing: proj/8")}
