import pytest


def types(rows):
    return [(r["rule"], r["type"]) for r in rows]


CASES = [
    ("condition_added", "x = 1", "if a:\n    x = 1", [("R01", "condition_added")]),
    ("condition_change", "if a > 1:\n    pass", "if a >= 1:\n    pass",
     [("R02", "condition_change"), ("R22", "if_condition_change")]),
    ("loop", "for i in range(3):\n    pass", "for j in range(4):\n    pass",
     [("R04", "loop_change"), ("R23", "for_loop_target_change"), ("R24", "for_loop_iterable_change")]),
    ("rename", "x = 1", "y = 1", [("R05", "var_rename"), ("R20", "assignment_target_change")]),
    ("value", "x = 1", "x = 2", [("R06", "var_value_change"), ("R21", "assignment_value_change")]),
    ("nested_def", "def g(a) -> int:\n    pass", "def g(a, b) -> str:\n    pass",
     [("R07", "param_change"), ("R08", "return_type_change"), ("R27", "function_arguments_change")]),
    ("nested_def_name", "def g():\n    pass", "def h():\n    pass", [("R26", "function_name_change")]),
    ("import", "import os", "import os as o", [("R09", "import_change")]),
    ("import_from", "from a import b", "from c import b", [("R10", "import_from_change")]),
    ("handlers", "try:\n    pass\nexcept ValueError:\n    pass", "try:\n    pass\nexcept KeyError:\n    pass",
     [("R11", "exception_handler_change"), ("R31", "exception_handler_change")]),
    ("bare_except", "try:\n    pass\nexcept:\n    pass", "try:\n    pass\nexcept KeyError:\n    pass",
     [("R11", "exception_handler_change"), ("R31", "exception_handler_change")]),
    ("raise", "raise ValueError", "raise KeyError", [("R12", "raise_change")]),
    ("class", "@d\nclass C(A):\n    pass", "class D(B):\n    pass",
     [("R13", "class_decorator_change"), ("R14", "class_inheritance_change"), ("R28", "class_name_change"),
      ("R29", "class_base_change")]),
    ("return", "return a - b", "return a + b", [("R17", "return_change"), ("R30", "return_value_change")]),
    ("bare_return", "return", "return 1", [("R17", "return_change"), ("R30", "return_value_change")]),
    ("while", "while a:\n    pass", "while b:\n    pass", [("R25", "while_condition_change")]),
    ("docstring_with", "with a:\n    'doc1'", "with a:\n    'doc2'", [("R33", "docstring_change")]),
    ("docstring_mixed", "for i in x:\n    'd1'", "if x:\n    'd2'",
     [("R01", "condition_added"), ("R33", "docstring_change")]),
    ("augassign", "x += 1", "x += 2", [("R35", "augmented_assignment_change")]),
    ("tail_if", "x = 1", "x = 1\nif a:\n    pass", [("R36", "condition_added")]),
]


@pytest.mark.parametrize("name,old,new,want", CASES, ids=[c[0] for c in CASES])
def test_rule_fires(diff, name, old, new, want):
    assert types(diff(old, new)) == want


@pytest.mark.parametrize("name,old,new,want", CASES, ids=[c[0] for c in CASES])
def test_rule_quiet_on_equal_code(diff, name, old, new, want):
    assert diff(old, old) == []
    assert diff(new, new) == []


def test_payloads(diff):
    r = diff("if a > 1:\n    pass", "if a >= 1:\n    pass")[0]
    assert (r["target"], r["old"], r["new"]) == ("a", "a > 1", "a >= 1")
    r = diff("x = 1", "if a:\n    x = 1")[0]
    assert (r["condition"], r["body"], r["function"]) == ("a", ["x = 1"], "f")
    r = diff("for i in range(3):\n    pass", "for j in range(4):\n    pass")[0]
    assert (r["target"], r["old"], r["new"]) == ("for j in range(4)", "for i in range(3)", "for j in range(4)")
    r = diff("def g(a) -> int:\n    pass", "def g(a, b) -> str:\n    pass")
    assert (r[0]["function"], r[0]["old_list"], r[0]["new_list"]) == ("g", ["a"], ["a", "b"])
    r = diff("try:\n    pass\nexcept:\n    pass", "try:\n    pass\nexcept KeyError:\n    pass")[0]
    assert (r["old_list"], r["new_list"]) == (["None"], ["KeyError"])
    r = diff("return", "return 1")[0]
    assert (r["old"], r["new"], r["function"]) == (None, "1", "f")
    r = diff("from a import b", "from c import b as d")[0]
    assert (r["module"], r["old_list"], r["new_list"]) == ("c", ["b"], ["b as d"])


def test_else_identity_semantics(diff):
    body = "if a:\n    pass\nelse:\n    pass"
    assert types(diff(body, body)) == [("R03", "else_block_change")]
    assert diff(body, body, mode="strict") == []


def test_decorator_rule_only_in_strict_mode(diff):
    old, new = "@d\ndef g():\n    pass", "@e\ndef g():\n    pass"
    assert diff(old, new) == []
    assert types(diff(old, new, mode="strict")) == [("R32", "function_decorator_change")]


def test_reordered(diff):
    rows = diff("a = 1\nb = 2", "b = 2\na = 1")
    assert types(rows) == [("R20", "assignment_target_change"), ("R21", "assignment_value_change"),
                           ("R20", "assignment_target_change"), ("R21", "assignment_value_change"),
                           ("R37", "statement_reordered"), ("R37", "statement_reordered")]
    moved = [(r["statement"], r["old_position"], r["new_position"]) for r in rows if r["rule"] == "R37"]
    assert moved == [("a = 1", 0, 1), ("b = 2", 1, 0)]


def test_repeated_statement_uses_first_index(diff):
    rows = [r for r in diff("a = 1\nb = 2\na = 1", "b = 2\na = 1") if r["rule"] == "R37"]
    assert [(r["statement"], r["old_position"], r["new_position"]) for r in rows] == [("a = 1", 0, 1), ("b = 2", 1, 0)]


NEGATIVES = [
    ("nested_body_edit", "if a:\n    x = 1", "if a:\n    x = 2"),
    ("if_disappears", "if a:\n    pass", "x = 1"),
    ("removed_tail", "x = 1\ny = 2", "x = 1"),
    ("annotated_assign", "x: int = 1", "x: int = 2"),
    ("assert", "assert a", "assert b"),
    ("expression_stmt", "print(a)", "print(b)"),
    ("delete", "del a", "del b"),
]


@pytest.mark.parametrize("name,old,new", NEGATIVES, ids=[c[0] for c in NEGATIVES])
def test_pinned_negatives(diff, name, old, new):
    assert diff(old, new) == []


def test_invisible_edits(diff):
    # module level, top-level parameters, async functions
    assert diff("X = 1\ndef f():\n    pass\n", "X = 2\ndef f():\n    pass\n", wrap=False) == []
    assert diff("def f(a):\n    pass\n", "def f(a, b):\n    pass\n", wrap=False) == []
    assert diff("async def f():\n    return 1\n", "async def f():\n    return 2\n", wrap=False) == []


def test_last_definition_wins_first_place_kept(diff):
    old = "def f():\n    return 1\ndef g():\n    return 5\ndef f():\n    return 2\n"
    new = "def g():\n    return 6\ndef f():\n    return 3\n"
    rows = diff(old, new, wrap=False)
    assert [(r["func"], r["first_ord"], r["old"]) for r in rows if r["rule"] == "R17"] == [("f", 0, "2"), ("g", 1, "5")]


def test_expression_level_rules(spark):
    import ast
    from patchlens.operators.extract import node_facts
    from patchlens.operators.rules import diff_nodes
    from patchlens.schemas import NODE
    from pyspark.sql import types as T

    def expr(src):
        return node_facts(ast.parse(src, mode="eval").body)

    pairs = [("c", "'a'", "'b'"), ("c2", "'a'", "1"), ("j", "f'{x}'", "f'{y}'"), ("call", "f(1)", "g(2)"),
             ("attr", "a.b", "a.c")]
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("old", NODE), T.StructField("new", NODE)])
    df = spark.createDataFrame([(k, expr(o), expr(n)) for k, o, n in pairs], schema)
    got = {}
    for r in diff_nodes(df).orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append(r.rule)
    assert got == {"c": ["R15"], "j": ["R16"], "call": ["R18", "R19"], "attr": ["R34"]}


def test_parse_error_is_a_row(spark):
    from patchlens.operators.extract import extract_functions
    from patchlens.plans.analyze import parse_status
    v = spark.createDataFrame([("bad", 0, "def f(:\n"), ("nul", 1, "x = '\x00'"), ("ok", 0, "def f():\n    pass")],
                              "pair_id string, version int, source string")
    f = extract_functions(v)
    st = {r.pair_id: r.status for r in parse_status(f).collect()}
    assert st == {"bad": "parse_error"} or st == {"bad": "parse_error", "nul": "parse_error"}
    assert [r.func for r in f.where("error is null").collect()] == ["f"]


def test_breadth_first_order(spark):
    from patchlens.operators.extract import extract_functions
    src = "def top():\n    def inner():\n        pass\nclass C:\n    def m(self):\n        pass\n    def n(self):\n        pass\n"
    v = spark.createDataFrame([("p", 0, src)], "pair_id string, version int, source string")
    got = [r.func for r in extract_functions(v).orderBy("walk_ord").collect()]
    assert got == ["top", "inner", "m", "n"]


def test_breadth_first_order_matches_full_walk():
    import ast
    from patchlens.operators.extract import functions_of_source
    src = ("class A:\n    def m(self):\n        def inner():\n            pass\n        try:\n            pass\n"
           "        except E:\n            def h():\n                pass\ndef top():\n    x = [lambda: 1]\n"
           "    match x:\n        case 1:\n            def mc():\n                pass\n"
           "async def skipped():\n    def in_async():\n        pass\n")
    full = [n.name for n in ast.walk(ast.parse(src)) if isinstance(n, ast.FunctionDef)]
    assert [r["func"] for r in functions_of_source("p", 0, src)] == full


def test_empty_targets_are_no_crash(spark):
    from pyspark.sql import functions as F

    from patchlens.operators.rules import diff_nodes
    from patchlens.schemas import NODE
    node = lambda kind, **f: F.struct(*[f.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) if x.name != "kind"
                                        else F.lit(kind).alias("kind") for x in NODE.fields])
    none = F.array().cast("array<string>")
    df = spark.range(1).select("id", node("Assign", targets=none, value=F.lit("1")).alias("old"),
                               node("Assign", targets=F.array(F.lit("a")), value=F.lit("1")).alias("new"))
    assert [(r.rule, r.old, r.new) for r in diff_nodes(df).collect()] == [("R05", None, "a"), ("R20", None, None)]
    df = spark.range(1).select("id", node("Expr", targets=none).alias("old"), node("Expr", targets=none).alias("new"))
    assert diff_nodes(df).count() == 0


def test_every_kind_cell_takes_one_branch_a_chain(spark):
    from pyspark.sql import functions as F

    from patchlens.operators.rules import CHAIN1_KINDS, CHAIN2_KINDS, CHAIN2_LATE_KINDS, RULES, diff_nodes
    from patchlens.schemas import NODE
    kinds = sorted({*CHAIN1_KINDS, *CHAIN2_KINDS, *CHAIN2_LATE_KINDS, "Expr", "With"})
    cells = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "ok string, nk string")

    def node(kind, side):
        fill = {"string": F.lit(side), "array<string>": F.array(F.lit(side)), "int": F.lit(0), "boolean": F.lit(True)}
        return F.struct(*[(kind if f.name == "kind" else fill[f.dataType.simpleString()]).cast(f.dataType).alias(f.name) for f in NODE.fields])

    rows = diff_nodes(cells.select("ok", "nk", node(F.col("ok"), "o").alias("old"), node(F.col("nk"), "n").alias("new"))).collect()
    branch = {r.rule: (r.chain, r.branch) for r in RULES}
    taken = {}
    for r in rows:
        taken.setdefault((r.ok, r.nk), set()).add(branch[r.rule])
    for (a, b) in ((a, b) for a in kinds for b in kinds):
        want = set()
        if b == "If" and a != "If":
            want.add((1, "if_added"))
        elif a == b and a in CHAIN1_KINDS and a != "Assign":  # its rules need an equal target or an equal value
            want.add((1, a))
        if a == b and a in CHAIN2_KINDS:
            want.add((2, a))
        else:
            want.add((2, "body"))
        assert taken.get((a, b), set()) == want, (a, b)
        assert [r.seq for r in rows if (r.ok, r.nk) == (a, b)] == list(range(len([r for r in rows if (r.ok, r.nk) == (a, b)])))


def test_odd_definitions(spark):
    from patchlens.operators.extract import extract_functions
    src = "async def no():\n    pass\ndef f(a, b=1, /, c=2, *d, e, **g):\n    x = ( 1 )\n    return  'q'\n"
    v = spark.createDataFrame([("p", 0, src)], "pair_id string, version int, source string")
    (r,) = extract_functions(v).collect()
    assert (r.func, r.args, [s.text for s in r.stmts]) == ("f", ["c"], ["x = 1", "return 'q'"])
