"""Writing again: what changes, what stays, and what is counted on the way."""

import pytest

from patchlens.plans.analyze import run_items
from patchlens.sources.changes_io import (write_changes, write_changes_json, write_outcomes, write_summaries, write_summary_files,
                                          write_versions)
from patchlens.sources.items import status_counts


def times(root, inside):
    return {str(f): f.stat().st_mtime_ns for f in sorted(root.rglob("*")) if f.is_file() and inside in str(f)}


@pytest.mark.parametrize("write, read", [(write_changes, "parquet"), (write_summaries, "parquet"), (write_changes_json, "text")])
def test_one_project_again_leaves_the_others(spark, tmp_path, write, read):
    columns = "project string, pair_id string, summary string, changes_json string, rule string"
    both = spark.createDataFrame([("p", "p/1", "one", '{"f":[]}', "R1"), ("q", "q/1", "two", '{"g":[]}', "R2"), ("q", "q/2", "three", "{}", "R3")], columns)
    out = tmp_path / "out"
    write(both, str(out), partition_by="project")
    q = times(out, "project=q")
    assert q
    again = spark.createDataFrame([("p", "p/1", "new", '{"h":[]}', "R4")], columns)
    for _ in range(2):
        write(again, str(out), partition_by="project")
        rows = getattr(spark.read, read)(str(out)).collect()
        assert len(rows) == 3 and sum("new" in str(r) or "R4" in str(r) or '"h"' in str(r) for r in rows) == 1
    assert times(out, "project=q") == q


def test_summaries_as_files(spark, tmp_path):
    texts = spark.createDataFrame([("p/1", "Function: f\n- x\n\n"), ("p/2", ""), (None, "lost")], "pair_id string, summary string")
    assert write_summary_files(texts, str(tmp_path / "s")) == 2
    assert (tmp_path / "s/p/1.txt").read_text() == "Function: f\n- x\n\n" and (tmp_path / "s/p/2.txt").read_text() == ""
    before = times(tmp_path / "s", "1.txt")
    write_summary_files(texts.replace("", "later", "summary"), str(tmp_path / "s"))
    assert times(tmp_path / "s", "1.txt") == before and (tmp_path / "s/p/2.txt").read_text() == "later"
    with pytest.raises(Exception, match="leads out"):
        write_summary_files(spark.createDataFrame([("../x", "y")], "pair_id string, summary string"), str(tmp_path / "s"))


def test_versions_as_files(spark, tmp_path):
    v = spark.createDataFrame([("i", 0, "a - b"), ("i", 1, "a + b"), ("j", 0, None)], "pair_id string, version int, source string")
    assert write_versions(v, str(tmp_path)) == 3
    assert (tmp_path / "i/code1.py").read_text() == "a - b" and (tmp_path / "i/code2.py").read_text() == "a + b"


def test_outcomes_are_counted_while_they_are_written(spark, tmp_path):
    parsed = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    items = spark.createDataFrame([
        ("1", "def f():\n    return 1\n", "def f():\n    return 2\n---EXPLANATION---\nx"), ("2", "def f(:\n", "def f():\n    pass\n---EXPLANATION---\ny"),
        ("3", "def f():\n    pass\n", "no delimiter"), ("4", "def f():\n    pass\n", "NO BUGS FOUND")], "pair_id string, source string, reply string")
    seen = items.mapInArrow(counting, items.schema)
    outcome = run_items(seen)["items"]
    counts = write_outcomes(outcome, str(tmp_path / "o"))
    assert parsed.value == 4  # each item once
    assert counts == {"ok": 1, "parse_error": 1, "no_delimiter": 1, "no_bug": 1}
    stored = spark.read.parquet(str(tmp_path / "o"))
    assert {(r.pair_id, r.quarantined) for r in stored.collect()} == {("1", "false"), ("4", "false"), ("2", "true"), ("3", "true")}
    again = {r.status: r.n for r in status_counts(stored.selectExpr("'p' as project", "status")).collect()}
    assert again == counts
