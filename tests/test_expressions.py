"""Mode ``extended``: expressions inside aligned statements, from source texts."""

import ast
import json

from patchlens.operators.extract import expression_pairs
from patchlens.plans.analyze import analyze_pairs, run_items


CASES = [
    ("x = 'a'", "x = 'b'", [("R15", "a", "b")]),
    ("x = 1", "x = 2", []),  # no text
    ("x = 'a'", "x = 2", []),
    ("x = f'{a} 1'", "x = f'{a} 2'", [("R16", "f'{a} 1'", "f'{a} 2'")]),
    ("g(a, 1)", "h(a, 1)", [("R18", "g", "h")]),
    ("g(a, 1)", "g(a, 2)", [("R19", ["a", "1"], ["a", "2"])]),
    ("g(a, 1)", "h(a, 'x')", [("R18", "g", "h"), ("R19", ["a", "1"], ["a", "'x'"])]),
    ("g(k='x')", "g(k='y')", [("R15", "x", "y")]),  # keywords are no positional arguments, but are walked
    ("a.b.c = 1", "a.x.c = 1", [("R34", "a.b.c", "a.x.c"), ("R34", "a.b", "a.x")]),
    ("return h('k', x.p)", "return h('m', x.q)", [("R19", ["'k'", "x.p"], ["'m'", "x.q"]), ("R15", "k", "m"), ("R34", "x.p", "x.q")]),
    ("if g('a'):\n    y = 'c'", "if g('b'):\n    y = 'd'", [("R19", ["'a'"], ["'b'"]), ("R15", "a", "b")]),  # the header, not the body
    ("for i in g(1):\n    pass", "for i in g(2):\n    pass", [("R19", ["1"], ["2"])]),
    ("x = g('a')", "return g('b')", []),  # kinds of statements part
    ("x = [g('a'), 'b']", "x = [g('a'), 'c', 'd']", [("R15", "b", "c")]),
    ("x = 'same'", "x = 'same'", []),
    ("with g('a') as t:\n    pass", "with g('b') as t:\n    pass", [("R19", ["'a'"], ["'b'"]), ("R15", "a", "b")]),
]


def test_records(spark):
    indent = lambda t: "".join(f"    {line}\n" for line in t.splitlines())
    df = spark.createDataFrame([(k, f"def f(a):\n{indent(old)}", f"def f(a):\n{indent(new)}") for k, (old, new, _) in enumerate(CASES)],
                               "pair_id int, old string, new string")
    got = {k: [] for k in range(len(CASES))}
    for r in analyze_pairs(df, "extended").where("phase = 1").orderBy("pos", "seq").collect():
        got[int(r.pair_id)].append((r.rule, r.old if r.old_list is None else r.old_list, r.new if r.new_list is None else r.new_list))
    for k, case in enumerate(CASES):
        assert got[k] == case[2], case


def test_statement_records_stay_as_they_are(spark):
    df = spark.createDataFrame([("i", "def f(a):\n    x = g('a')\n    return a.b\n", "def f(a):\n    x = g('b')\n    return a.c\n")], "pair_id string, old string, new string")
    strip = lambda rows: [(r.phase, r.pos, r.seq, r.rule, r.old, r.new) for r in rows]
    plain = strip(analyze_pairs(df).orderBy("phase", "pos", "seq").collect())
    wide = strip(analyze_pairs(df, "extended").orderBy("phase", "pos", "seq").collect())
    assert [r for r in wide if r[0] != 1] == plain and {r[3] for r in wide} - {r[3] for r in plain} == {"R19", "R15", "R34"}


def test_records_reach_texts(spark):
    items = spark.createDataFrame([("1", "def f(a):\n    g(a.x, 'p', f'{a}')\n", "def f(a):\n    h(a.y, 'q', f'{a}!')\n---EXPLANATION---\ncalls h")],
                                  "pair_id string, source string, reply string")
    out = run_items(items, mode="extended")["items"].first()
    types = [r["type"] for r in json.loads(out.changes_json)["f"]]
    assert types == ["function_call_change", "function_arguments_change", "attribute_assignment_change", "string_change", "fstring_change"]
    assert out.n_changes == 5 and "Change of type 'string_change' detected." in out.summary
    assert run_items(items)["items"].first().n_changes == 0


def test_walk_is_left_to_right_and_outermost_first():
    def one(text):
        return ast.parse(text).body[0]
    got = [(ast.unparse(a), ast.unparse(b)) for a, b in expression_pairs(one("f(g('a').x, 'b')"), one("f(g('c').x, 'd')"))]
    assert got == [("f(g('a').x, 'b')", "f(g('c').x, 'd')"), ("g('a').x", "g('c').x"), ("g('a')", "g('c')"), ("'a'", "'c'"), ("'b'", "'d'")]


def test_deep_expressions_end_as_an_outcome(spark):
    deep = "def f(a):\n    return " + "a(" * 3000 + ")" * 3000 + "\n"
    items = spark.createDataFrame([("1", deep, deep.replace("a(", "b(", 1) + "---EXPLANATION---\nx"), ("2", "def f():\n    return 1\n", "def f():\n    return 2\n---EXPLANATION---\nx")],
                                  "pair_id string, source string, reply string")
    got = {r.pair_id: r.status for r in run_items(items, mode="extended")["items"].collect()}
    assert got == {"1": "parse_error", "2": "ok"}
