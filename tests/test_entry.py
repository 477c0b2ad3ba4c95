import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_contract_keys():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    from patchlens.plans.catalog import QUERIES
    assert set(o) <= set(q) and set(QUERIES) <= set(o)
    assert not any(k.startswith("op") and k[2:3].isdigit() for k in QUERIES)


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_alone(tmp_path, pipeline):
    """A copy without the training-data folders, with and without the pipeline's file."""
    copy = tmp_path / "copy"
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(Path(__file__).parents[1], copy, ignore=skipped)
    code = ("import __spark_entry__ as e; from patchlens.plans.catalog import QUERIES; "
            "assert set(e.queries()) == set(e.oracle_sql()) == set(QUERIES); print(len(QUERIES))")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 41


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["pair_id", "model", "score", "shown", "is_match", "error"]
    assert len(rows) > 0


FAST = ["patch_path", "item_status", "reply_parse", "reply_clean", "functions_join", "reordered",
        "diff_conditions", "diff_assign", "changes_json", "summary_text", "score_models", "extract_functions",
        "summary_from_json", "diff_strict", "render_all_types", "score_pairs", "end_to_end"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_small(spark, name):
    from __spark_entry__ import oracle_sql, queries
    from patchlens.plans.catalog import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    s_rows = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    res = con.execute(oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(o_cols) == cols
    idx = [o_cols.index(c) for c in cols]
    o_rows = sorted(tuple(repr(r[i]) for i in idx) for r in res.fetchall())
    assert s_rows == o_rows
