import json


def test_golden_chain(spark):
    from patchlens.operators.render import item_texts
    from patchlens.plans.analyze import analyze_corpus
    v = spark.createDataFrame([("g", 0, "def add(a ,b):\n    return a - b"),
                               ("g", 1, "def add(a ,b):\n    return a + b")],
                              "pair_id string, version int, source string")
    ch = analyze_corpus(v)
    t = item_texts(ch).collect()[0]
    assert json.loads(t.changes_json) == {"add": [
        {"type": "return_change", "old": "a - b", "new": "a + b", "function": "add"},
        {"type": "return_value_change", "old": "a - b", "new": "a + b"}]}
    assert t.summary == ("Function: add\n- Change of type 'return_change' detected.\n"
                         "- Change of type 'return_value_change' detected.\n\n")


def test_write_and_read_changes(spark, tmp_path):
    from patchlens.operators.render import item_texts
    from patchlens.plans.analyze import analyze_corpus
    from patchlens.sources.changes_io import read_changes, write_changes_json
    v = spark.createDataFrame([("g", 0, "def f():\n    import os\n    return 1"),
                               ("g", 1, "def f():\n    import sys\n    return 2")],
                              "pair_id string, version int, source string")
    texts = item_texts(analyze_corpus(v))
    write_changes_json(texts, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    doc = json.loads(line)
    assert doc["pair_id"] == "g"
    assert doc["changes"]["f"][0] == {"type": "import_change", "old": ["os"], "new": ["sys"]}
    back = read_changes(texts).collect()
    assert [r.type for r in back] == ["import_change", "return_change", "return_value_change"]
    assert back[0].old_list == ["os"] and back[0].rule == "R09" and back[1].old == "1"


def test_stored_change_sets_render_like_fresh_ones(spark, tmp_path):
    from pyspark.sql import functions as F

    from patchlens.operators.render import item_texts, summarize
    from patchlens.plans.analyze import analyze_corpus
    from patchlens.sources.changes_io import read_changes, write_changes, write_changes_json, write_summaries
    old = "def f(a):\n    import os\n    x = [1, 2]\n    if a:\n        pass\n    return a\ndef g():\n    a.b = 1\n    c()\n"
    new = "def f(a):\n    import sys\n    if a > 1:\n        pass\n    x = [1, 2]\n    return b\n    if z:\n        q()\ndef g():\n    c()\n    a.b = 1\n"
    v = spark.createDataFrame([("g", 0, old), ("g", 1, new)], "pair_id string, version int, source string")
    changes = analyze_corpus(v)
    fresh = item_texts(changes).first()
    assert {"R36", "R37"} <= {r.rule for r in changes.collect()}
    write_changes(changes, str(tmp_path / "rows"))
    write_changes_json(item_texts(changes), str(tmp_path / "json"))
    write_summaries(item_texts(changes), str(tmp_path / "texts"))
    assert summarize(spark.read.parquet(str(tmp_path / "rows"))).first().summary == fresh.summary
    assert spark.read.parquet(str(tmp_path / "texts")).first().summary == fresh.summary
    line = spark.read.text(str(tmp_path / "json")).select(
        F.get_json_object("value", "$.pair_id").alias("pair_id"), F.get_json_object("value", "$.changes").alias("changes_json"))
    back = item_texts(read_changes(line)).first()
    assert back.summary == fresh.summary and json.loads(back.changes_json) == json.loads(fresh.changes_json)
