"""Source text -> function rows with statement facts, or both versions of an
item -> the aligned statements of its functions present in both.

This is the only Python stage of the engine. Each task parses the files of its
Arrow batch with the standard-library parser and emits flat facts; the rules, joins and
groupings afterwards are Spark expressions. Where both versions are at hand, statements are aligned here: a text is
made only where the sources do not show that both statements are the same, and facts only of pairs that some rule can take.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import FUNCTION, NODE, NODE_FIELDS, PHASE_EXPRESSION, PHASE_REORDER, PHASE_SLOT, SLOT
from .rules import EXTENDED, branches, fields_by_branch
from .unparse import dump, unparse as _u

_ARROW_SCHEMA = to_arrow_schema(FUNCTION)
_FLUSH_ROWS = 512
_FLUSH_SLOTS = 2048
#: Bytes of a statement up to which its source stands for its text. A node's depth is less than its bytes, so such a statement has a text: it
#: cannot pass the limit on recursion.
_SHORT = 120
_PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError, TypeError)
_CONTAINERS = (ast.stmt, ast.excepthandler, ast.match_case)
# fields that hold statements, in a node's own order of fields
_NESTED = {kind: tuple(f for f in kind._fields if f in ("body", "handlers", "orelse", "finalbody", "cases"))
           for kind in (ast.Module, *(k for k in vars(ast).values() if isinstance(k, type) and issubclass(k, _CONTAINERS)))}
_NO_FACTS = dict.fromkeys(NODE_FIELDS)
# kinds of expressions that rules read, and all that have a place in the source
_EXPRESSIONS = (ast.Constant, ast.JoinedStr, ast.Call, ast.Attribute)
_PLACED = {k for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.expr)}
_DECORATED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
# fields that hold expressions or what has such in it; the parts of a formatted string are not looked at
_BARE = (str, int, object, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)
_INNER = {kind: tuple(f for f, t in kind._field_types.items() if kind is not ast.JoinedStr and f not in _NESTED.get(kind, ())
                      and not {t, *getattr(t, "__args__", ())} & set(_BARE))
          for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) and hasattr(kind, "_field_types")}


def _alias_list(aliases):
    return [f"{a.name} as {a.asname}" if a.asname else a.name for a in aliases]


class Texts(dict):
    """The texts of nodes, each made when it is first asked for."""

    def __missing__(self, node) -> str:
        kind = node.__class__
        if kind is ast.Name:
            text = node.id
        # as they are written whole, but with the value's text
        elif kind is ast.Assign and len(node.targets) == 1 and node.targets[0].__class__ is ast.Name and node.type_comment is None:
            text = f"{node.targets[0].id} = {self[node.value]}"
        elif kind is ast.Return and node.value is not None:
            text = f"return {self[node.value]}"
        else:
            text = _u(node)
        self[node] = text
        return text


def _docstring(node) -> str | None:
    body = node.body
    if isinstance(body, list) and body:
        first = body[0]
        if (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant)
                and isinstance(first.value.value, str)):
            return first.value.value
    return None


def _value(n, u):
    return u(n.value) if n.value is not None else None


def _names(n, u):
    return _alias_list(n.names)


def _decorators(n, u):
    return [u(d) for d in n.decorator_list]


#: How each field of a NODE is made of a node and the texts of its parts, by the node's kind; ``kind``, ``text`` and what tells of a body are any node's.
_MADE: dict[str, dict[str, Callable]] = {
    "If": {"test": lambda n, u: u(n.test), "body_texts": lambda n, u: [u(b) for b in n.body], "orelse_n": lambda n, u: len(n.orelse),
           "orelse_texts": lambda n, u: [u(b) for b in n.orelse]},
    "While": {"test": lambda n, u: u(n.test)},
    "For": {"target": lambda n, u: u(n.target), "iter": lambda n, u: u(n.iter)},
    "Assign": {"targets": lambda n, u: [u(t) for t in n.targets], "value": _value},
    "Return": {"value": _value},
    "FunctionDef": {"name": lambda n, u: n.name, "params": lambda n, u: [a.arg for a in n.args.args],
                    "returns": lambda n, u: u(n.returns) if n.returns is not None else None, "decorators": _decorators},
    "ClassDef": {"name": lambda n, u: n.name, "decorators": _decorators, "bases": lambda n, u: [u(b) for b in n.bases]},
    "Import": {"names": _names},
    "ImportFrom": {"module": lambda n, u: n.module, "names": _names},
    "Try": {"handlers": lambda n, u: [u(h.type) if h.type is not None else "None" for h in n.handlers]},
    "Raise": {"exc": lambda n, u: u(n.exc) if n.exc is not None else None},
    "Constant": {"const_str": lambda n, u: n.value if isinstance(n.value, str) else None},
    "Call": {"func_dump": lambda n, u: dump(n.func), "func_text": lambda n, u: u(n.func), "args": lambda n, u: [u(a) for a in n.args]},
}


def node_facts(node: ast.AST, else_texts: bool = True, text: str | None = None) -> dict:
    """Flatten one node into the NODE struct (missing facts stay null). The texts of an ``else``
    are left out where no rule reads them. ``text`` is the node's own text where it is known."""
    kind = type(node).__name__
    f = _NO_FACTS.copy()
    f["kind"] = kind
    f["text"] = _u(node) if text is None else text
    for field, make in _MADE.get(kind, {}).items():
        if else_texts or field != "orelse_texts":
            f[field] = make(node, _u)
    f["has_body"] = hasattr(node, "body")
    if f["has_body"]:
        f["docstring"] = _docstring(node)
    return f


class _Source:
    """A file's bytes, and the place at which each line begins, so that a node's source is found by its lines and columns; not of files with
    line ends or marks that the parser counts in its own way."""

    def __init__(self, text: str):
        self.data = text.encode()
        self.starts = [0, *accumulate(len(line) + 1 for line in self.data.split(b"\n"))]

    @classmethod
    def of(cls, text: str) -> _Source | None:
        return None if "\r" in text or "\f" in text or "\ufeff" in text else cls(text)


def expression_pairs(old: ast.stmt, new: ast.stmt):
    """The pairs of ``differing`` alone."""
    return differing(old, new, Texts().__getitem__)


def differing(old: ast.stmt, new: ast.stmt, u: Callable, before: _Source | None = None, after: _Source | None = None):
    """Two aligned statements walked in parallel: pairs of expressions at the same place, of the same kind and with
    different texts (made by ``u``), outermost first, from left to right. The walk ends where kinds part and does not enter
    the statements of a body, nor the parts of a formatted string; nor expressions that are the same in the sources ``before`` and ``after``,
    where these are given."""
    if placed := before is not None and after is not None:
        (data, starts), (other, begins) = (before.data, before.starts), (after.data, after.starts)
    todo = [(old, new)]
    while todo:
        a, b = todo.pop()
        kind = a.__class__
        if kind is not b.__class__:
            continue
        if (placed and kind in _PLACED and data[starts[a.lineno - 1] + a.col_offset:starts[a.end_lineno - 1] + a.end_col_offset]
                == other[begins[b.lineno - 1] + b.col_offset:begins[b.end_lineno - 1] + b.end_col_offset]):
            continue
        if kind in _EXPRESSIONS:
            if u(a) == u(b):
                continue
            yield a, b
        inner = []
        for field in _INNER[kind]:
            x, y = getattr(a, field), getattr(b, field)
            # names hold no expression
            if x.__class__ is list:
                inner += [(c, d) for c, d in zip(x, y) if c.__class__ is not ast.Name and c is not None and d is not None]
            elif x is not None and y is not None and x.__class__ is not ast.Name:
                inner.append((x, y))
        inner.reverse()
        todo += inner


def definitions(source):
    """Plain ``def`` nodes of a file, breadth-first over every nesting level. Expression
    subtrees never hold a definition, so only statement containers are queued; dropping the
    rest keeps the relative breadth-first order of the definitions."""
    queue = [ast.parse(source)]
    for node in queue:
        for field in _NESTED[node.__class__]:
            queue += [n for n in getattr(node, field) if _NESTED[n.__class__]]
        if isinstance(node, ast.FunctionDef):
            yield node


def _error_text(exc):
    return f"{type(exc).__name__}: {exc}"


def functions_of_source(pair_id, version, source):
    """FUNCTION rows of one file; a file that cannot be parsed gives one error row."""
    try:
        return [{"pair_id": pair_id, "version": version, "func": node.name, "walk_ord": k,
                 "args": [a.arg for a in node.args.args],
                 "stmts": [node_facts(s) for s in node.body], "error": None}
                for k, node in enumerate(definitions(source))]
    except _PARSE_ERRORS as exc:
        return [{"pair_id": pair_id, "version": version, "func": None, "walk_ord": None,
                 "args": None, "stmts": None, "error": _error_text(exc)}]


def _same_sources(old: list, new: list, before: _Source, after: _Source) -> list[bool]:
    """Of each place in either body, whether both statements are one short text in their sources; decorators stand outside a node's place."""
    (data, starts), (other, begins) = (before.data, before.starts), (after.data, after.starts)
    out = []
    for a, b in zip(old, new):
        same = a is b
        if not same and a.__class__ is b.__class__:
            i, j = starts[a.lineno - 1] + a.col_offset, starts[a.end_lineno - 1] + a.end_col_offset
            k = begins[b.lineno - 1] + b.col_offset
            same = (begins[b.end_lineno - 1] + b.end_col_offset - k == j - i and data[i:j] == other[k:k + j - i]
                    and not (a.__class__ in _DECORATED and (a.decorator_list or b.decorator_list)))
        out.append(same and starts[a.end_lineno - 1] + a.end_col_offset - starts[a.lineno - 1] - a.col_offset <= _SHORT)
    return out + [False] * (max(len(old), len(new)) - len(out))


def _likeness(node: ast.stmt):
    """What statements of one text have in common, and others seldom; much cheaper than the text."""
    kind = node.__class__
    if kind is ast.Assign:
        target = node.targets[0]
        return kind, target.id if target.__class__ is ast.Name else target.__class__, node.value.__class__
    if kind is ast.Return or kind is ast.Expr:
        return kind, node.value.__class__
    if kind is ast.If or kind is ast.While:
        return kind, node.test.__class__
    return kind


def statement_texts(old: list, new: list, u: Callable, before: _Source | None = None, after: _Source | None = None) -> tuple[list, list]:
    """The texts of two bodies' statements, None in both where both are one in the sources and no statement that differs is like them: such
    a pair has no record of a change, and its text is at the same first place on both sides."""
    if before is None or after is None:
        return [u(n) for n in old], [u(n) for n in new]
    same = _same_sources(old, new, before, after)
    if all(same):
        return [None] * len(old), [None] * len(new)
    odd = {_likeness(n) for side in (old, new) for n, s in zip(side, same) if not s}
    own = [None if s and _likeness(n) not in odd else u(n) for n, s in zip(old, same)]
    return own, [own[k] if s else u(n) for k, (n, s) in enumerate(zip(new, same))]


def moved_statements(old: list, new: list) -> list[tuple[int, str, int]]:
    """(old place, text, new place) of texts on both sides whose first places differ, in the order of the old body; None is no text."""
    if old == new:
        return []
    first: tuple[dict, dict] = ({}, {})
    for side, found in zip((old, new), first):
        for k, text in enumerate(side):
            if text is not None:
                found.setdefault(text, k)
    return [(k, text, first[1][text]) for text, k in first[0].items() if first[1].get(text, k) != k]


@dataclass
class _Plan:
    """A sort of rows: its phase, each side's kind (None: no node there) and whether it has a body, and the columns it fills, as
    (values, how a value is made) for each side."""

    phase: int | None
    kinds: tuple = (None, None)
    bodies: tuple = (False, False)
    fields: tuple = ((), ())


class _Slots:
    """SLOT rows by columns. A row notes the number of its sort, and adds to its sort's columns only; where a column's values belong follows
    from the sorts when a batch is made."""

    OWN, MOVED = 0, 1

    def __init__(self, schema: T.StructType, mode: str, read: dict[str, tuple[set[str], set[str]]], carry: tuple[str, ...] = ()):
        self.strict, self.read, self.carry = mode == "strict", read, carry
        self.arrow, self.node = to_arrow_schema(schema), to_arrow_schema(NODE)
        # of the function that rows belong to: the first row and its keys
        self.starts, self.keys = [], {c: [] for c in ("pair_id", "func", "first_ord")}
        self.sorts: list[int] = []
        self.pos: list[int | None] = []
        self.values = {c: [] for c in ("error", "statement", "old_position", "new_position", *carry)}
        self.nodes = {(side, f): [] for side in (0, 1) for f in NODE_FIELDS}
        self.plans: list[_Plan] = [_Plan(None), _Plan(PHASE_REORDER)]
        self.numbers: dict[tuple, int | None] = {}

    @property
    def rows(self) -> int:
        return len(self.sorts)

    def function(self, pair_id, func, first_ord) -> None:
        """The rows that follow are of this function."""
        self.starts.append(len(self.sorts))
        for held, key in zip(self.keys.values(), (pair_id, func, first_ord)):
            held.append(key)

    def item(self, pair_id, error, carried) -> None:
        self.function(pair_id, None, None)
        self.sorts.append(self.OWN)
        self.pos.append(None)
        self.values["error"].append(error)
        for c, value in zip(self.carry, carried):
            self.values[c].append(value)

    def moved(self, old: int, text: str, new: int) -> None:
        self.sorts.append(self.MOVED)
        self.pos.append(old)
        for c, value in (("statement", text), ("old_position", old), ("new_position", new)):
            self.values[c].append(value)

    def number(self, kinds: tuple) -> int | None:
        """The sort of rows of two nodes of these classes (None: no node), made when it is first asked for; None: no rule takes them."""
        old, new = kinds
        names = None if old is None else old.__name__, new.__name__
        bodies = old is not None and "body" in old._fields, "body" in new._fields
        taken = branches(*names, all(bodies))
        found = None
        if taken:
            found = len(self.plans)
            fields = []
            for side, name in enumerate(names):
                made = {**_MADE.get(name, {}), **({"docstring": lambda n, u: _docstring(n)} if bodies[side] else {}), "text": lambda n, u: u(n)}
                fields.append([(self.nodes[side, f], make) for f, make in made.items() if name and any(f in self.read[b][side] for b in taken)])
            self.plans.append(_Plan(PHASE_EXPRESSION if issubclass(new, ast.expr) else PHASE_SLOT, names, bodies, tuple(fields)))
        self.numbers[kinds] = found
        return found

    def pair(self, a: ast.AST | None, b: ast.AST, pos: int, u: Callable) -> None:
        """A row of two nodes, if some rule can take them."""
        kinds = (a.__class__ if a is not None else None), b.__class__
        number = self.numbers[kinds] if kinds in self.numbers else self.number(kinds)
        if number is None:
            return
        old, new = self.plans[number].fields
        for held, make in old:
            held.append(make(a, u))
        for held, make in new:
            held.append(make(b, u))
        self.sorts.append(number)
        self.pos.append(pos)

    def batch(self) -> pa.RecordBatch:
        n = len(self.sorts)
        sorts = np.array(self.sorts, "int64")

        def of_sorts(values, kind: pa.DataType) -> pa.Array:
            return pa.array(list(values), kind).take(pa.array(sorts))

        def column(held: list, here, kind: pa.DataType) -> pa.Array:
            """``held``, a value for each row of a sort that is ``here``; null in the others."""
            if not held:
                return pa.nulls(n, kind)
            at = np.array(here)[sorts]
            return pa.array(held, kind).take(pa.array(np.cumsum(at) - 1, mask=~at))

        def nodes(side: int) -> pa.Array:
            made = []
            for f in self.node:
                held = self.nodes[side, f.name]
                if f.name == "kind":
                    made.append(of_sorts((p.kinds[side] for p in self.plans), f.type))
                elif f.name == "has_body":
                    made.append(of_sorts((p.bodies[side] for p in self.plans), f.type))
                else:
                    made.append(column(held, [any(h is held for h, _ in p.fields[side]) for p in self.plans], f.type))
                held.clear()
            absent = np.array([p.kinds[side] is None for p in self.plans])[sorts]
            return pa.StructArray.from_arrays(made, fields=list(self.node), mask=pa.array(absent))

        runs = pa.array(np.repeat(np.arange(len(self.starts)), np.diff(self.starts, append=n)))
        made = []
        for f in self.arrow:
            if f.name in self.keys:
                made.append(pa.array(self.keys[f.name], f.type).take(runs))
            elif f.name in ("old", "new"):
                made.append(nodes(("old", "new").index(f.name)))
            elif f.name == "phase":
                made.append(of_sorts((p.phase for p in self.plans), f.type))
            elif f.name == "pos":
                made.append(pa.array(self.pos, f.type))
            else:
                own = self.OWN if f.name == "error" or f.name in self.carry else self.MOVED
                made.append(column(self.values[f.name], [k == own for k in range(len(self.plans))], f.type))
        for held in (self.starts, self.sorts, self.pos, *self.keys.values(), *self.values.values()):
            held.clear()
        return pa.RecordBatch.from_arrays(made, schema=self.arrow)


def _versions(old: str | None, new: str | None) -> tuple[list[dict], dict]:
    """Of each version the last definition of a name, and the place of its first one in the old file. A text that is both versions is
    parsed once."""
    found, first = [], {}
    for side, source in enumerate((old, new)):
        if side and source is not None and source == old:
            found.append(found[0])
            continue
        last = {}
        for k, node in enumerate(definitions(source) if source is not None else ()):
            last[node.name] = node
            if side == 0:
                first.setdefault(node.name, k)
        found.append(last)
    return found, first


def slots_of_pair(out: _Slots, pair_id, old, new, expressions=False, carried=()) -> None:
    """SLOT rows of one item: its own row, and those of its functions in both versions. The last
    definition of a name wins, its first one gives the place in the old file. With ``expressions``, the
    pairs of expressions of aligned statements that differ have rows too."""
    todo, own = [], None
    try:
        found, first = _versions(old, new)
        matched = [name for name in found[0] if name in found[1]]
        before, after = (_Source.of(old), _Source.of(new)) if matched else (None, None)
        u = Texts().__getitem__
        # all that can fail comes before the item's first row
        for name in matched:
            a, b = found[0][name].body, found[1][name].body
            texts, others = statement_texts(a, b, u, before, after)
            odd = [(x, y) for x, y, p, q in zip(a, b, texts, others) if p != q]
            todo.append((name, first[name], a, b, texts, others, [pair for x, y in odd for pair in differing(x, y, u, before, after)] if expressions else ()))
    except _PARSE_ERRORS as exc:
        out.item(pair_id, _error_text(exc), carried)
        return
    out.item(pair_id, None, carried)
    for name, place, a, b, texts, others, inside in todo:
        out.function(pair_id, name, place)
        for k, y in enumerate(b):
            x = a[k] if k < len(a) else None
            # equal texts hold equal facts; but any ``else`` counts as a change where it is compared by identity
            if x is None or texts[k] != others[k] or (y.__class__ is ast.If and y.orelse and not out.strict):
                out.pair(x, y, k, u)
        for k, (x, y) in enumerate(inside):
            out.pair(x, y, k, u)
        for moved in moved_statements(texts, others):
            out.moved(*moved)


class _Functions:
    """FUNCTION rows."""

    def __init__(self):
        self.held: list[dict] = []

    @property
    def rows(self) -> int:
        return len(self.held)

    def batch(self) -> pa.RecordBatch:
        held, self.held = self.held, []
        return pa.RecordBatch.from_pylist(held, schema=_ARROW_SCHEMA)


def _flushed(items: Iterable, rows: _Functions | _Slots, most: int) -> Iterator[pa.RecordBatch]:
    """``rows``, filled by the run through ``items``, in batches of ``most`` and more. A syntax tree holds no cycle, so none is looked for while
    trees are made: the collector would walk every tree several times before it is dropped."""
    on = gc.isenabled()
    try:
        gc.disable()
        for _ in items:
            if rows.rows >= most:
                yield rows.batch()
                gc.collect(0)
        if rows.rows:
            yield rows.batch()
    finally:
        if on:
            gc.enable()


def _extract_batches(batches):
    rows = _Functions()

    def items():
        for batch in batches:
            cols = batch.to_pydict()
            for pid, ver, src in zip(cols["pair_id"], cols["version"], cols["source"]):
                if src is not None:
                    rows.held += functions_of_source(pid, ver, src)
                    yield

    yield from _flushed(items(), rows, _FLUSH_ROWS)


def extract_functions(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """(pair_id, version, source) -> FUNCTION rows (parse failures as rows with ``error``).

    Only the three input columns cross into Python. ``partitions`` deals the files out before parsing, for inputs with few, fat splits.
    """
    src = versions.select(
        F.col("pair_id").cast("string").alias("pair_id"),
        F.col("version").cast("int").alias("version"),
        F.col("source").cast("string").alias("source"),
    )
    if partitions:
        src = src.repartition(partitions)
    return src.mapInArrow(_extract_batches, FUNCTION)


def extract_pairs(items: DataFrame, carry: tuple[str, ...] = (), mode: str = "reference") -> DataFrame:
    """(pair_id, old, new) -> SLOT rows; both versions are parsed, and their functions' statements aligned, where they lie.

    ``carry`` names string columns that travel on each item's own row, once per item. A node holds what the rules of ``mode`` read of it; mode
    ``extended`` adds the differing expression pairs of aligned statements.
    """
    schema = T.StructType([*SLOT, *(T.StructField(c, T.StringType()) for c in carry)])
    read = fields_by_branch("reference" if mode == EXTENDED else mode)

    def run(batches):
        rows = _Slots(schema, mode, read, carry)

        def found():
            for batch in batches:
                cols = batch.to_pydict()
                extra = list(zip(*(cols[c] for c in carry))) or [()] * batch.num_rows
                for pid, old, new, more in zip(cols["pair_id"], cols["old"], cols["new"], extra):
                    yield slots_of_pair(rows, pid, old, new, mode == EXTENDED, more)

        yield from _flushed(found(), rows, _FLUSH_SLOTS)

    src = items.select(*[F.col(c).cast("string").alias(c) for c in ("pair_id", "old", "new", *carry)])
    return src.mapInArrow(run, schema)
