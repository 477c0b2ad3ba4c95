"""The parse stage aligns statements, and makes only what some rule can read."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from patchlens.operators import extract
from patchlens.operators.extract import Texts, _Source, extract_pairs, moved_statements, statement_texts
from patchlens.operators.rules import branch1, branch2, branches

ITEM = ("i", "def f(a):\n    x = 1\n    y = a\n    if a:\n        z = 'é'\n    else:\n        z = 2\n    print(a)\n    return g('é', a.b)\n",
        "def f(a):\n    x  =  1  # as before\n    y = b\n    if a:\n        z = 'é'\n    else:\n        z = 2\n    print(b)\n    return g('e', a.c)\n    if x:\n        pass\n")
COLUMNS = "pair_id string, old string, new string"


def test_only_pairs_that_rules_can_take_have_rows(spark):
    df = spark.createDataFrame([ITEM, ("none", None, None), (None, "def f(:", ITEM[2]), ("other", "def f():\n    x = 1\n", "def g():\n    x = 2\n")], COLUMNS)
    rows = lambda mode: extract_pairs(df, mode=mode).collect()
    slots = [(r.pair_id, r.func, r.phase, r.pos, r.old and r.old.kind, r.new and r.new.kind) for r in rows("reference")]
    # x and print(a) or print(b) can make no record; an else counts as a change in mode reference
    assert sorted(slots, key=str) == sorted([
        ("i", None, None, None, None, None), ("none", None, None, None, None, None), (None, None, None, None, None, None), ("other", None, None, None, None, None),
        ("i", "f", 0, 1, "Assign", "Assign"), ("i", "f", 0, 2, "If", "If"), ("i", "f", 0, 4, "Return", "Return"), ("i", "f", 0, 5, None, "If")], key=str)
    assert [r.error is not None for r in rows("reference") if r.pair_id is None] == [True]
    assert {r.pos for r in rows("strict") if r.phase == 0} == {1, 4, 5}
    inside = [(r.pos, r.old.kind, r.old.func_text, r.old.args, r.old.const_str, r.old.text) for r in rows("extended") if r.phase == 1]
    assert sorted(inside) == [(0, "Call", "print", ["a"], None, None), (1, "Call", "g", ["'é'", "a.b"], None, None), (2, "Constant", None, None, "é", None),
                              (3, "Attribute", None, None, None, "a.b")]
    tail = [r.new for r in rows("reference") if r.pos == 5][0]
    assert (tail.test, tail.body_texts, tail.has_body) == ("x", ["pass"], True)


def test_no_text_is_made_of_statements_that_the_sources_show_to_be_the_same():
    old, new = (ast.parse(t).body[0].body for t in ITEM[1:])
    asked = []
    memo = Texts()
    got = statement_texts(old, new[:5], lambda n: asked.append(n) or memo[n], *map(_Source.of, ITEM[1:]))
    # the first statement's text is made, since its source differs; that of the ``if`` is not, being like no other
    assert [[t is None for t in side] for side in got] == [[False, False, True, False, False]] * 2
    assert len(asked) == 8 and got[0][0] == got[1][0] == "x = 1"
    # but one like it may be it
    assert None not in statement_texts(old, new, memo.__getitem__, *map(_Source.of, ITEM[1:]))[0]


def test_files_whose_lines_the_parser_counts_in_its_own_way_are_compared_by_texts():
    assert _Source.of("a\rb") is None and _Source.of("\fa") is None and _Source.of("\ufeffa") is None
    got = _Source.of("é = 'ü'\nif é:\n  y = 1\n")
    cut = lambda n: got.data[got.starts[n.lineno - 1] + n.col_offset:got.starts[n.end_lineno - 1] + n.end_col_offset].decode()
    tree = ast.parse("é = 'ü'\nif é:\n  y = 1\n").body
    assert [cut(n) for n in (tree[0], tree[0].value, tree[1])] == ["é = 'ü'", "'ü'", "if é:\n  y = 1"]


def test_moved_statements_are_those_of_all_texts():
    rng = random.Random(3)
    forms = ["x = 1", "x  = 1", "x = 'a'", "y = 1", "f(x)", "f( x)", "return x", "if x:\n        y = 1", "@d\n    def g(): pass", "@e\n    def g(): pass", "z = " + "1 + " * 60 + "1"]
    for _ in range(600):
        sides = [[rng.choice(forms) for _ in range(rng.randrange(1, 7))] for _ in range(2)]
        if rng.random() < 0.6:
            sides[1] = list(sides[0])
            sides[1][rng.randrange(len(sides[1]))] = rng.choice(forms)
        sources = ["def f():\n" + "".join(f"    {t}\n" for t in side) for side in sides]
        old, new = (ast.parse(t).body[0].body for t in sources)
        texts = [[ast.unparse(n) for n in body] for body in (old, new)]
        want = [(texts[0].index(t), t, texts[1].index(t)) for t in dict.fromkeys(texts[0]) if t in texts[1] and texts[0].index(t) != texts[1].index(t)]
        found = statement_texts(old, new, Texts().__getitem__, *map(_Source.of, sources))
        assert moved_statements(*found) == want, sources
        assert [a == b for a, b in zip(*found)] == [a == b for a, b in zip(*texts)]


def test_plain_branches_are_those_of_the_columns(spark):
    kinds = {k.__name__: "body" in k._fields for k in vars(ast).values() if isinstance(k, type) and issubclass(k, (ast.stmt, ast.expr))}
    node = lambda k: (k, kinds[k]) if k else None
    pairs = [(o, n) for o in (None, *kinds) for n in kinds]
    df = spark.createDataFrame([(node(o), node(n)) for o, n in pairs], "o struct<kind:string,has_body:boolean>, n struct<kind:string,has_body:boolean>")
    got = df.select(F.col("o.kind").alias("ok"), F.col("n.kind").alias("nk"), branch1(F.col("o"), F.col("n")).alias("b1"), branch2(F.col("o"), F.col("n")).alias("b2")).collect()
    for r in got:
        if r.ok is not None:
            assert branches(r.ok, r.nk, kinds[r.ok] and kinds[r.nk]) == [b for b in (r.b1, r.b2) if b], r
    assert branches(None, "If", False) == ["if_added"] and branches(None, "For", False) == []


def test_a_text_that_is_both_versions_is_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(extract, "definitions", lambda t: parsed.append(t) or (n for n in ast.parse(t).body))
    text = "def f():\n    return 1\n"
    found, first = extract._versions(text, text)
    assert parsed == [text] and found[0] == found[1] and first == {"f": 0}
    extract._versions(text, text + "\n")
    assert len(parsed) == 3


@pytest.mark.parametrize("text", ["x = yield y", "x = 1, 2", "x = (y := 2)", "x = lambda: 1", "return", "return 1, *a", "return (yield)", "x = y = 1", "x.a = 1", "x, y = y, x", "x = a if b else c"])
def test_texts_of_parts_make_the_library_s_text(text):
    node = ast.parse(f"def f():\n    {text}").body[0].body[0]
    assert Texts()[node] == ast.unparse(node)
