"""Typed change records from aligned statement pairs, as one projection.

Two independent first-match chains run on every aligned pair. Each chain picks at
most one branch (``branch1`` / ``branch2``, computed once per row); a branch owns a few
rules, each of which may emit a record. The branch comes first: a pair has as many
candidates as the largest branches have rules, not one for every rule, and which of them
fire is computed once, as plain columns. Candidates are two numbers each, exploded from a plain array
and the empty ones filtered; the payload is built after that, for the records that are left.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_WS_CLASS, apart
from ..schemas import CHANGE_PAYLOAD, NODE

MODES = ("reference", "strict")
# of whole analyses: the reference's rules, on the expressions inside aligned statements too
EXTENDED = "extended"

# Kinds whose same-kind pairs own a branch in chain 1 / chain 2 (first match wins;
# a new ``if`` facing any other kind is checked before them in chain 1).
CHAIN1_KINDS = ("If", "For", "Assign", "FunctionDef", "Import", "ImportFrom", "Try",
                "Raise", "ClassDef", "Constant", "JoinedStr", "Return")
CHAIN2_KINDS = ("Call", "Assign", "If", "For", "While", "FunctionDef", "ClassDef",
                "Return", "Try")
CHAIN2_LATE_KINDS = ("Attribute", "AugAssign")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def first_token(c: Column) -> Column:
    """Python ``s.split()[0]``: first run of non-whitespace, punctuation kept."""
    return F.regexp_extract(c, f"^{PY_WS_CLASS}*([^{PY_WS_CLASS[1:-1]}]+)", 1)


def blank_payload() -> dict[str, Column]:
    """A null for every payload field; made once for all records of a plan."""
    return {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in CHANGE_PAYLOAD.fields}


def change_struct(rule: str, type_: str, blank: dict[str, Column] | None = None, **payload: Column) -> Column:
    given = {"rule": F.lit(rule), "type": F.lit(type_), **payload}
    made = {f.name: given[f.name].cast(f.dataType).alias(f.name) for f in CHANGE_PAYLOAD.fields if f.name in given}
    return F.struct(*({**(blank or blank_payload()), **made}.values()))


@dataclass(frozen=True)
class Rule:
    rule: str
    type: str
    # JSON keys in record order after ``type``; ``old[]`` means the list column
    keys: tuple
    chain: int
    branch: str | None
    when: Callable | None  # (o, n, mode) -> Column; None: whenever the branch is taken
    payload: Callable | None  # (o, n, fn) -> dict[str, Column]
    pipe: str = "Y"  # Y: fires from files, N: expression pairs only, X: dead in reference mode


def _lists(o, n, field):
    return {"old_list": o[field], "new_list": n[field]}


def _strs(o, n, field):
    return {"old": o[field], "new": n[field]}


def _loop(node):
    return F.concat(F.lit("for "), node["target"], F.lit(" in "), node["iter"])


def _else_changed(o, n, mode):
    if mode == "strict":
        return differs(o["orelse_texts"], n["orelse_texts"])
    # reference semantics: else bodies are compared by object identity, so any
    # else/elif on either side counts as a change
    return (F.coalesce(o["orelse_n"], F.lit(0)) > 0) | (F.coalesce(n["orelse_n"], F.lit(0)) > 0)


RULES: list[Rule] = [
    # ---- chain 1
    Rule("R01", "condition_added", ("condition", "body[]", "function"),
         1, "if_added", None,
         lambda o, n, fn: {"condition": n["test"], "body": n["body_texts"], "function": fn}),
    Rule("R02", "condition_change", ("target", "old", "new"),
         1, "If", lambda o, n, m: differs(o["test"], n["test"]),
         lambda o, n, fn: {"target": first_token(n["test"]), **_strs(o, n, "test")}),
    Rule("R03", "else_block_change", ("function",),
         1, "If", lambda o, n, m: _else_changed(o, n, m),
         lambda o, n, fn: {"function": fn}),
    Rule("R04", "loop_change", ("target", "old", "new"),
         1, "For", lambda o, n, m: (differs(o["target"], n["target"]) | differs(o["iter"], n["iter"])),
         lambda o, n, fn: {"target": _loop(n), "old": _loop(o), "new": _loop(n)}),
    Rule("R05", "var_rename", ("old", "new"),
         1, "Assign", lambda o, n, m: differs(F.get(o["targets"], 0), F.get(n["targets"], 0)) & same(o["value"], n["value"]),
         lambda o, n, fn: {"old": F.get(o["targets"], 0), "new": F.get(n["targets"], 0)}),
    Rule("R06", "var_value_change", ("target", "old", "new"),
         1, "Assign", lambda o, n, m: same(F.get(o["targets"], 0), F.get(n["targets"], 0)) & differs(o["value"], n["value"]),
         lambda o, n, fn: {"target": F.get(o["targets"], 0), **_strs(o, n, "value")}),
    Rule("R07", "param_change", ("function", "old[]", "new[]"),
         1, "FunctionDef", lambda o, n, m: differs(o["params"], n["params"]),
         lambda o, n, fn: {"function": o["name"], **_lists(o, n, "params")}),
    Rule("R08", "return_type_change", ("function", "old", "new"),
         1, "FunctionDef", lambda o, n, m: differs(o["returns"], n["returns"]),
         lambda o, n, fn: {"function": o["name"], **_strs(o, n, "returns")}),
    Rule("R09", "import_change", ("old[]", "new[]"),
         1, "Import", lambda o, n, m: differs(o["names"], n["names"]),
         lambda o, n, fn: _lists(o, n, "names")),
    Rule("R10", "import_from_change", ("module", "old[]", "new[]"),
         1, "ImportFrom", lambda o, n, m: (differs(o["module"], n["module"]) | differs(o["names"], n["names"])),
         lambda o, n, fn: {"module": n["module"], **_lists(o, n, "names")}),
    Rule("R11", "exception_handler_change", ("old[]", "new[]"),
         1, "Try", lambda o, n, m: differs(o["handlers"], n["handlers"]),
         lambda o, n, fn: _lists(o, n, "handlers")),
    Rule("R12", "raise_change", ("old", "new"),
         1, "Raise", lambda o, n, m: differs(o["exc"], n["exc"]),
         lambda o, n, fn: _strs(o, n, "exc")),
    Rule("R13", "class_decorator_change", ("class", "old[]", "new[]"),
         1, "ClassDef", lambda o, n, m: differs(o["decorators"], n["decorators"]),
         lambda o, n, fn: {"class": o["name"], **_lists(o, n, "decorators")}),
    Rule("R14", "class_inheritance_change", ("class", "old[]", "new[]"),
         1, "ClassDef", lambda o, n, m: differs(o["bases"], n["bases"]),
         lambda o, n, fn: {"class": o["name"], **_lists(o, n, "bases")}),
    Rule("R15", "string_change", ("old", "new"),
         1, "Constant", lambda o, n, m: o["const_str"].isNotNull() & n["const_str"].isNotNull()
         & differs(o["const_str"], n["const_str"]),
         lambda o, n, fn: _strs(o, n, "const_str"), pipe="N"),
    Rule("R16", "fstring_change", ("old", "new"),
         1, "JoinedStr", lambda o, n, m: differs(o["text"], n["text"]),
         lambda o, n, fn: _strs(o, n, "text"), pipe="N"),
    Rule("R17", "return_change", ("old", "new", "function"),
         1, "Return", lambda o, n, m: differs(o["value"], n["value"]),
         lambda o, n, fn: {**_strs(o, n, "value"), "function": fn}),
    # ---- chain 2
    Rule("R18", "function_call_change", ("old", "new"),
         2, "Call", lambda o, n, m: differs(o["func_dump"], n["func_dump"]),
         lambda o, n, fn: _strs(o, n, "func_text"), pipe="N"),
    Rule("R19", "function_arguments_change", ("old[]", "new[]"),
         2, "Call", lambda o, n, m: differs(o["args"], n["args"]),
         lambda o, n, fn: _lists(o, n, "args"), pipe="N"),
    Rule("R20", "assignment_target_change", ("old[]", "new[]"),
         2, "Assign", lambda o, n, m: differs(o["targets"], n["targets"]),
         lambda o, n, fn: _lists(o, n, "targets")),
    Rule("R21", "assignment_value_change", ("old", "new"),
         2, "Assign", lambda o, n, m: differs(o["value"], n["value"]),
         lambda o, n, fn: _strs(o, n, "value")),
    Rule("R22", "if_condition_change", ("old", "new"),
         2, "If", lambda o, n, m: differs(o["test"], n["test"]),
         lambda o, n, fn: _strs(o, n, "test")),
    Rule("R23", "for_loop_target_change", ("old", "new"),
         2, "For", lambda o, n, m: differs(o["target"], n["target"]),
         lambda o, n, fn: _strs(o, n, "target")),
    Rule("R24", "for_loop_iterable_change", ("old", "new"),
         2, "For", lambda o, n, m: differs(o["iter"], n["iter"]),
         lambda o, n, fn: _strs(o, n, "iter")),
    Rule("R25", "while_condition_change", ("old", "new"),
         2, "While", lambda o, n, m: differs(o["test"], n["test"]),
         lambda o, n, fn: _strs(o, n, "test")),
    Rule("R26", "function_name_change", ("old", "new"),
         2, "FunctionDef", lambda o, n, m: differs(o["name"], n["name"]),
         lambda o, n, fn: _strs(o, n, "name")),
    Rule("R27", "function_arguments_change", ("old[]", "new[]"),
         2, "FunctionDef", lambda o, n, m: differs(o["params"], n["params"]),
         lambda o, n, fn: _lists(o, n, "params")),
    Rule("R32", "function_decorator_change", ("function", "old[]", "new[]"),
         2, "FunctionDef", lambda o, n, m: differs(o["decorators"], n["decorators"]),
         lambda o, n, fn: {"function": o["name"], **_lists(o, n, "decorators")}, pipe="X"),
    Rule("R28", "class_name_change", ("old", "new"),
         2, "ClassDef", lambda o, n, m: differs(o["name"], n["name"]),
         lambda o, n, fn: _strs(o, n, "name")),
    Rule("R29", "class_base_change", ("old[]", "new[]"),
         2, "ClassDef", lambda o, n, m: differs(o["bases"], n["bases"]),
         lambda o, n, fn: _lists(o, n, "bases")),
    Rule("R30", "return_value_change", ("old", "new"),
         2, "Return", lambda o, n, m: differs(o["value"], n["value"]),
         lambda o, n, fn: _strs(o, n, "value")),
    Rule("R31", "exception_handler_change", ("old[]", "new[]"),
         2, "Try", lambda o, n, m: differs(o["handlers"], n["handlers"]),
         lambda o, n, fn: _lists(o, n, "handlers")),
    Rule("R33", "docstring_change", ("old", "new"),
         2, "body", lambda o, n, m: o["docstring"].isNotNull() & n["docstring"].isNotNull()
         & differs(o["docstring"], n["docstring"]),
         lambda o, n, fn: _strs(o, n, "docstring")),
    Rule("R34", "attribute_assignment_change", ("old", "new"),
         2, "Attribute", lambda o, n, m: differs(o["text"], n["text"]),
         lambda o, n, fn: _strs(o, n, "text"), pipe="N"),
    Rule("R35", "augmented_assignment_change", ("old", "new"),
         2, "AugAssign", lambda o, n, m: differs(o["text"], n["text"]),
         lambda o, n, fn: _strs(o, n, "text")),
]

# Records emitted outside the per-pair chains.
TAIL_RULE = Rule("R36", "condition_added", ("condition", "body[]", "function"), 0, None,
                 lambda o, n, m: o.isNull() & (n["kind"] == "If"),
                 lambda o, n, fn: {"condition": n["test"], "body": n["body_texts"], "function": fn})
REORDER_RULE = Rule("R37", "statement_reordered",
                    ("statement", "old_position", "new_position", "function"), 0, None, None, None)

ALL_RULES = RULES + [TAIL_RULE, REORDER_RULE]
#: Code of a row that carries no record.
NO_RULE = -1
RULE_KEYS = {r.rule: r.keys for r in ALL_RULES}
RULE_TYPES = {r.rule: r.type for r in ALL_RULES}


def branch1(o: Column, n: Column) -> Column:
    both = o.isNotNull() & n.isNotNull()
    ok, nk = o["kind"], n["kind"]
    return (F.when(~both, F.lit(None).cast("string"))
            .when((nk == "If") & (ok != "If"), F.lit("if_added"))
            .when((ok == nk) & ok.isin(*CHAIN1_KINDS), ok))


def branch2(o: Column, n: Column) -> Column:
    both = o.isNotNull() & n.isNotNull()
    ok, nk = o["kind"], n["kind"]
    return (F.when(~both, F.lit(None).cast("string"))
            .when((ok == nk) & ok.isin(*CHAIN2_KINDS), ok)
            .when(F.coalesce(o["has_body"], F.lit(False)) & F.coalesce(n["has_body"], F.lit(False)), F.lit("body"))
            .when((ok == nk) & ok.isin(*CHAIN2_LATE_KINDS), ok))


def branches(old: str | None, new: str, bodies: bool) -> list[str]:
    """``branch1`` and ``branch2`` (those taken) of plain kinds, and the tail's for an ``old`` of None; ``bodies``: both nodes have one."""
    if new == "If" and old != "If":
        first = "if_added"
    else:
        first = new if old == new and new in CHAIN1_KINDS else None
    second = None
    if old == new and new in CHAIN2_KINDS:
        second = new
    elif old is not None and bodies:
        second = "body"
    elif old == new and new in CHAIN2_LATE_KINDS:
        second = new
    return [b for b in (first, second) if b]


def _by_branch(chain: int, mode: str) -> dict[str, list[Rule]]:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out: dict[str, list[Rule]] = {}
    for r in RULES:
        if r.chain == chain and (r.pipe != "X" or mode == "strict"):
            out.setdefault(r.branch, []).append(r)
    return out


def _places(mode: str) -> list[tuple[int, list[Rule]]]:
    """(chain, rules) of each candidate: the k-th rule of every branch of the chain. Emission order."""
    out = []
    for chain in (1, 2):
        branches = _by_branch(chain, mode).values()
        for k in range(max(map(len, branches))):
            out.append((chain, [rules[k] for rules in branches if len(rules) > k]))
    return out


def with_firing(pairs: DataFrame, mode: str = "reference", old: str = "_o", new: str = "_n") -> DataFrame:
    """``pairs`` with the branches taken and which candidates fire (``_f0``, ``_f1``, ...)."""
    o, n = F.col(old), F.col(new)
    staged = pairs.select("*", branch1(o, n).alias("_b1"), branch2(o, n).alias("_b2"))
    fires = []
    for chain, rules in _places(mode):
        branch, case = F.col(f"_b{chain}"), F
        for r in rules:
            case = case.when(branch == r.branch, F.lit(True) if r.when is None else r.when(o, n, mode))
        fires.append(F.coalesce(case, F.lit(False)))
    fires.append(F.coalesce(apart(TAIL_RULE.when(o, n, mode)), F.lit(False)))
    return staged.select("*", *[f.alias(f"_f{k}") for k, f in enumerate(fires)])


def _code(rule: Rule) -> int:
    return ALL_RULES.index(rule)


def candidate(fires: Column, code: Column, seq: Column | None = None) -> Column:
    return F.when(fires, F.struct((F.lit(0) if seq is None else seq).alias("seq"), code.alias("code")))


def candidates(mode: str = "reference") -> list[Column]:
    """One struct (seq, code) or null for each candidate of a pair from ``with_firing``: ``code`` is its rule's place in ``ALL_RULES``,
    ``seq`` counts the records emitted before it."""
    out = []
    for k, (chain, rules) in enumerate([*_places(mode), (0, [TAIL_RULE])]):
        before = sum((F.col(f"_f{j}").cast("int") for j in range(k)), F.lit(0))
        code = F
        for r in rules:
            code = code.when(F.col(f"_b{chain}") == r.branch, F.lit(_code(r))) if chain else F.lit(_code(r))
        out.append(candidate(F.col(f"_f{k}"), code, before))
    return out


def payload_columns(fn: Column, mode: str = "reference", old: str = "_o", new: str = "_n", reordered: dict[str, Column] | None = None) -> list[Column]:
    """``seq`` and the CHANGE_PAYLOAD columns of the candidate ``_c``: a field is one choice among the rules that give it, so only
    records that fired are built. ``reordered`` has what a reordered statement's record holds."""
    o, n, code = F.col(old), F.col(new), F.col("_c.code")
    cases = {f.name: F for f in CHANGE_PAYLOAD.fields}
    for r in ALL_RULES:
        if r is REORDER_RULE:
            payload = reordered
        else:
            payload = r.payload(o, n, fn) if r.pipe != "X" or mode == "strict" else None
        if payload is None:
            continue
        for name, value in {"rule": F.lit(r.rule), "type": F.lit(r.type), **payload}.items():
            cases[name] = cases[name].when(code == _code(r), value)
    return [apart(F.col("_c.seq")).alias("seq"), *[(F.lit(None) if cases[f.name] is F else cases[f.name]).cast(f.dataType).alias(f.name)
                                            for f in CHANGE_PAYLOAD.fields]]


class _Reading:
    """A node that notes which of its fields a rule reads."""

    def __init__(self, node: Column):
        self.node, self.fields = node, set()

    def __getitem__(self, field: str) -> Column:
        self.fields.add(field)
        return self.node[field]

    def isNull(self) -> Column:
        return self.node.isNull()


def fields_by_branch(mode: str = "reference") -> dict[str, tuple[set[str], set[str]]]:
    """The NODE fields that the rules of each branch read, of the old and the new side; the tail's rule reads as ``if_added`` does."""
    found: dict[str, tuple[set[str], set[str]]] = {}
    fn = F.lit(None).cast("string")
    for r in [r for chain in (1, 2) for rules in _by_branch(chain, mode).values() for r in rules] + [TAIL_RULE]:
        sides = _Reading(F.col("_o")), _Reading(F.col("_n"))
        if r.when is not None:
            r.when(*sides, mode)
        if r.payload is not None:
            r.payload(*sides, fn)
        for side, fields in zip(sides, found.setdefault("if_added" if r is TAIL_RULE else r.branch, (set(), set()))):
            fields |= side.fields
    return found


def read_fields(mode: str = "reference") -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    """For the old and the new side: each NODE field that some rule reads, with the branches of these rules. A branch is the kind of the nodes
    whose fields it reads, but for ``body``, which takes any kind that has one."""
    found: tuple[dict[str, set[str]], dict[str, set[str]]] = ({}, {})
    for branch, sides in fields_by_branch(mode).items():
        for names, fields in zip(sides, found):
            for f in names:
                fields.setdefault(f, set()).add("If" if branch == "if_added" else branch)
    return found


def read_node(node: dict[str, Column], fields: dict[str, set[str]]) -> Column:
    """A NODE struct of the columns in ``node``, null in place of what no rule reads of a node of its kind; that is not made, then."""
    out = []
    for f in NODE.fields:
        kinds, c = sorted(fields.get(f.name, ())), node[f.name]
        if f.name not in ("kind", "has_body") and "body" not in kinds:
            c = F.when(node["kind"].isin(kinds), c) if kinds else F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return F.struct(*out)


def may_fire(o: Column, n: Column) -> Column:
    """False or null only for pairs that no branch takes and that are no tail; reads nothing but kinds and ``has_body``. Stands apart, since
    filters are pushed down to where kinds are made and repeat that expression."""
    return ((o["kind"] == n["kind"]) & n["kind"].isin(*dict.fromkeys(CHAIN1_KINDS + CHAIN2_KINDS + CHAIN2_LATE_KINDS))
            | (n["kind"] == "If") | (o["has_body"] & apart(n["has_body"])))


def diff_nodes(pairs: DataFrame, mode: str = "reference", old: str | dict[str, Column] = "old", new: str | dict[str, Column] = "new",
               func: str = "func", keys: list[str] | None = None) -> DataFrame:
    """Aligned node pairs -> one row per change record.

    ``pairs`` carries any key columns plus ``old``/``new`` NODE structs and the
    enclosing function name. Output adds ``seq`` (emission index within the pair)
    and the CHANGE_PAYLOAD columns. Nodes of any kind are accepted. Instead of a struct's name, ``old`` or ``new`` may give the
    column of each NODE field; a field is then computed only for kinds of which a rule reads it. Pairs that no rule can take are
    dropped on their kinds, before any other field is made. ``keys`` names the key columns, if these are not all others.
    """
    given, fields = {"_o": old, "_n": new}, dict(zip(("_o", "_n"), read_fields(mode)))
    if keys is None:
        keys = [c for c in pairs.columns if c not in [n for n in given.values() if isinstance(n, str)]]
    kinds = [F.col(c) if isinstance(c, str) else F.struct(*[c[f].alias(f) for f in ("kind", "has_body")]) for c in given.values()]
    nodes = [(F.col(c) if isinstance(c, str) else read_node(c, fields[side])).alias(side) for side, c in given.items()]
    staged = with_firing(pairs.where(may_fire(*kinds)).select(*keys, *nodes), mode)
    fn = F.col(func) if func in keys else F.lit(None).cast("string")
    out = staged.select(*keys, "_o", "_n", F.explode(F.array(*candidates(mode))).alias("_c")).where(F.col("_c").isNotNull())
    return out.select(*keys, *payload_columns(fn, mode))
