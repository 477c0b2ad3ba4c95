from pyspark.sql import functions as F


def parse(spark, replies):
    from patchlens.sources.replies import parse_replies
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(replies)], "pair_id string, reply string")
    return [(r.status, r.fixed, r.explanation) for r in parse_replies(df).orderBy(F.col("pair_id").cast("int")).collect()]


def test_sentinel_and_delimiters(spark):
    got = parse(spark, ["NO BUGS FOUND", "NO BUGS FOUND\n", "just code",
                        "code\n---EXPLANATION---\nwhy", "a---EXPLANATION---b---EXPLANATION---c"])
    assert got == [("no_bug", "", None), ("no_delimiter", None, None), ("no_delimiter", None, None),
                   ("ok", "code", "\nwhy"), ("ok", "a", "b---EXPLANATION---c")]


def test_fence_cleanup(spark):
    from patchlens.functions.text import clean_code_block
    cases = {
        "```python\nx = 1\n```": "x = 1",
        "```\nx = 1\n```": "x = 1",
        "  ```python\nx = 1\n```": "```python\nx = 1",
        "x = 1```": "x = 1",
        "Fixed Code:\n```python\nx = 1\n```": "x = 1",
        "fixed code:   x = 1": "x = 1",
        "```python\r\nx = 1\r\n```": "x = 1",
        # only \n ends a line: a fence followed by \r\n is not at a line end
        "```python\r\nx = 1```\r\ny": "x = 1```\r\ny",
        "  x = 1　": "x = 1",
        "Fixed Code: ```python\nx = 1": "```python\nx = 1",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", clean_code_block(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_normalise_and_request(spark):
    from patchlens.functions.text import normalise
    from patchlens.sources.replies import render_requests
    df = spark.createDataFrame([("\t Ünd  Ça\n\x1c",)], "t string")
    assert df.select(normalise(F.col("t"))).first()[0] == "ünd  ça"
    req = render_requests(spark.createDataFrame([("x = 1",)], "source string")).first().request
    assert req.startswith("\n    You are a senior software engineer.\n")
    assert req.endswith("    Code:\n    x = 1\n    ")
    assert "'---EXPLANATION---'" in req and '"NO BUGS FOUND"' in req
