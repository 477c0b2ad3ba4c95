"""The canonical text of a syntax node, as ``ast.unparse`` gives it.

The standard library's writer goes through a visitor call, a precedence table and context managers for every node. The usual kinds
are written here by one function a kind, which returns the node's text; any other kind, and what is nested deeper than
``DEEPEST``, sends the whole node to ``ast.unparse``. So the text is the same for every node, and so are its errors.
"""

from __future__ import annotations

import ast
import re

#: Levels of nesting that are written here; the library's own limit on recursion is far beyond.
DEEPEST = 40

# how tightly an expression binds, in the library's order
TUPLE, YIELD, TEST, OR, AND, NOT, CMP, BOR, BXOR, BAND, SHIFT, ARITH, TERM, FACTOR, POWER, AWAIT, ATOM = range(1, 18)
_BINARY = {ast.Add: ("+", ARITH), ast.Sub: ("-", ARITH), ast.Mult: ("*", TERM), ast.MatMult: ("@", TERM), ast.Div: ("/", TERM),
           ast.Mod: ("%", TERM), ast.FloorDiv: ("//", TERM), ast.LShift: ("<<", SHIFT), ast.RShift: (">>", SHIFT),
           ast.BitOr: ("|", BOR), ast.BitXor: ("^", BXOR), ast.BitAnd: ("&", BAND), ast.Pow: ("**", POWER)}
_UNARY = {ast.Not: ("not ", NOT), ast.USub: ("-", FACTOR), ast.UAdd: ("+", FACTOR), ast.Invert: ("~", FACTOR)}
_BOOLEAN = {ast.And: (" and ", AND), ast.Or: (" or ", OR)}
_COMPARED = {ast.Eq: " == ", ast.NotEq: " != ", ast.Lt: " < ", ast.LtE: " <= ", ast.Gt: " > ", ast.GtE: " >= ", ast.Is: " is ",
             ast.IsNot: " is not ", ast.In: " in ", ast.NotIn: " not in "}
_AS_REPR = (int, str, bool, bytes, type(None))
# parts of a formatted string that need no choice of quotes and no escapes
_PLAIN_PART = re.compile(r"[ !#-&(-\[\]-z|~]*")
_PLAIN_VALUE = re.compile(r"[ !#-&(-\[\]-z|~][ !#-&(-\[\]-~]*")


class _Other(Exception):
    """A node that is left to the library."""


def _expr(node, prec, depth):
    write = _EXPRESSIONS.get(node.__class__)
    if write is None or depth > DEEPEST:
        raise _Other
    return write(node, prec, depth + 1)


def _name(node, prec, depth):
    return node.id


def _constant(node, prec, depth):
    value = node.value
    if node.kind is None:
        if value.__class__ in _AS_REPR:
            return repr(value)
        if value is ...:
            return "..."
        if value.__class__ is float and "inf" not in (text := repr(value)):
            return text
    raise _Other


def _attribute(node, prec, depth):
    value = node.value
    if value.__class__ is ast.Constant and isinstance(value.value, int):
        raise _Other
    return f"{_expr(value, ATOM, depth)}.{node.attr}"


def _call(node, prec, depth):
    parts = [_expr(a, TEST, depth) for a in node.args]
    for k in node.keywords:
        value = _expr(k.value, TEST, depth)
        parts.append(f"**{value}" if k.arg is None else f"{k.arg}={value}")
    return f"{_expr(node.func, ATOM, depth)}({', '.join(parts)})"


def _starred(node, prec, depth):
    return "*" + _expr(node.value, BOR, depth)


def _binary(node, prec, depth):
    sign, own = _BINARY[node.op.__class__]
    left, right = (own + 1, own) if own == POWER else (own, own + 1)
    text = f"{_expr(node.left, left, depth)} {sign} {_expr(node.right, right, depth)}"
    return f"({text})" if prec > own else text


def _unary(node, prec, depth):
    sign, own = _UNARY[node.op.__class__]
    text = sign + _expr(node.operand, own, depth)
    return f"({text})" if prec > own else text


def _boolean(node, prec, depth):
    sign, own = _BOOLEAN[node.op.__class__]
    text = sign.join([_expr(v, min(own + k, ATOM), depth) for k, v in enumerate(node.values, 1)])
    return f"({text})" if prec > own else text


def _compare(node, prec, depth):
    text = _expr(node.left, CMP + 1, depth) + "".join(
        [_COMPARED[o.__class__] + _expr(c, CMP + 1, depth) for o, c in zip(node.ops, node.comparators)])
    return f"({text})" if prec > CMP else text


def _items(nodes, depth):
    texts = [_expr(e, TEST, depth) for e in nodes]
    return texts[0] + "," if len(texts) == 1 else ", ".join(texts)


def _subscript(node, prec, depth):
    inner = node.slice
    if inner.__class__ is ast.Tuple and inner.elts:
        text = _items(inner.elts, depth + 1)
    else:
        text = _expr(inner, TEST, depth)
    return f"{_expr(node.value, ATOM, depth)}[{text}]"


def _slice(node, prec, depth):
    low, high = (_expr(e, TEST, depth) if e is not None else "" for e in (node.lower, node.upper))
    return f"{low}:{high}" + (f":{_expr(node.step, TEST, depth)}" if node.step is not None else "")


def _list(node, prec, depth):
    return f"[{', '.join([_expr(e, TEST, depth) for e in node.elts])}]"


def _tuple(node, prec, depth):
    if not node.elts:
        return "()"
    text = _items(node.elts, depth)
    return f"({text})" if prec > TUPLE else text


def _joined(node, prec, depth):
    parts = []
    for v in node.values:
        if v.__class__ is ast.Constant:
            if not _PLAIN_PART.fullmatch(v.value):
                raise _Other
            parts.append(v.value)
        elif v.__class__ is ast.FormattedValue and v.conversion == -1 and v.format_spec is None:
            text = _expr(v.value, TEST + 1, depth)
            if not _PLAIN_VALUE.fullmatch(text):
                raise _Other
            parts.append(f"{{{text}}}")
        else:
            raise _Other
    return f"f'{''.join(parts)}'"


_EXPRESSIONS = {ast.Name: _name, ast.Constant: _constant, ast.Attribute: _attribute, ast.Call: _call, ast.Starred: _starred, ast.BinOp: _binary,
                ast.UnaryOp: _unary, ast.BoolOp: _boolean, ast.Compare: _compare, ast.Subscript: _subscript, ast.Slice: _slice, ast.List: _list,
                ast.Tuple: _tuple, ast.JoinedStr: _joined}


def _stmt(node, indent, depth):
    write = _STATEMENTS.get(node.__class__)
    if write is None or depth > DEEPEST:
        raise _Other
    return write(node, indent, depth + 1)


def _block(nodes, indent, depth):
    inner = indent + "    "
    # a definition has an empty line before it
    return "".join([("\n\n" if n.__class__ is ast.FunctionDef else "\n") + inner + _stmt(n, inner, depth) for n in nodes])


def _value(node, indent, depth):
    return _expr(node.value, YIELD, depth)


def _assign(node, indent, depth):
    if node.type_comment is not None:
        raise _Other
    return "".join([_expr(t, TUPLE, depth) + " = " for t in node.targets]) + _expr(node.value, TEST, depth)


def _augmented(node, indent, depth):
    return f"{_expr(node.target, TEST, depth)} {_BINARY[node.op.__class__][0]}= {_expr(node.value, TEST, depth)}"


def _return(node, indent, depth):
    return "return" if node.value is None else "return " + _expr(node.value, TEST, depth)


def _raise(node, indent, depth):
    if node.exc is None:
        raise _Other
    return "raise " + _expr(node.exc, TEST, depth) + (f" from {_expr(node.cause, TEST, depth)}" if node.cause is not None else "")


def _else(nodes, indent, depth):
    return f"\n{indent}else:{_block(nodes, indent, depth)}" if nodes else ""


def _if(node, indent, depth):
    text = f"if {_expr(node.test, TEST, depth)}:{_block(node.body, indent, depth)}"
    rest = node.orelse
    while len(rest) == 1 and rest[0].__class__ is ast.If:
        text += f"\n{indent}elif {_expr(rest[0].test, TEST, depth)}:{_block(rest[0].body, indent, depth)}"
        rest = rest[0].orelse
    return text + _else(rest, indent, depth)


def _while(node, indent, depth):
    return f"while {_expr(node.test, TEST, depth)}:{_block(node.body, indent, depth)}{_else(node.orelse, indent, depth)}"


def _for(node, indent, depth):
    if node.type_comment is not None:
        raise _Other
    head = f"for {_expr(node.target, TUPLE, depth)} in {_expr(node.iter, TEST, depth)}:"
    return f"{head}{_block(node.body, indent, depth)}{_else(node.orelse, indent, depth)}"


def _function(node, indent, depth):
    a, first = node.args, node.body[0]
    if (node.decorator_list or node.type_params or node.type_comment is not None or a.posonlyargs or a.vararg or a.kwonlyargs or a.kwarg or a.defaults
            or (first.__class__ is ast.Expr and first.value.__class__ is ast.Constant and isinstance(first.value.value, str))):
        raise _Other
    names = []
    for p in a.args:
        if p.annotation is not None or p.type_comment is not None:
            raise _Other
        names.append(p.arg)
    returns = f" -> {_expr(node.returns, TEST, depth)}" if node.returns is not None else ""
    return f"def {node.name}({', '.join(names)}){returns}:{_block(node.body, indent, depth)}"


_STATEMENTS = {ast.Expr: _value, ast.Assign: _assign, ast.AugAssign: _augmented, ast.Return: _return, ast.Raise: _raise, ast.If: _if, ast.While: _while,
               ast.For: _for, ast.FunctionDef: _function, ast.Pass: lambda node, indent, depth: "pass"}


def unparse(node: ast.AST) -> str:
    """``ast.unparse(node)`` of a statement or an expression."""
    try:
        if node.__class__ in _STATEMENTS:
            return _stmt(node, "", 0)
        return _expr(node, TEST, 0)
    except _Other:
        return ast.unparse(node)


def dump(node: ast.expr) -> str:
    """``ast.dump(node)``; names and attributes of names are written here."""
    inner, attrs = node, []
    while inner.__class__ is ast.Attribute and inner.ctx.__class__ is ast.Load and len(attrs) < DEEPEST:
        attrs.append(inner.attr)
        inner = inner.value
    if inner.__class__ is not ast.Name or inner.ctx.__class__ is not ast.Load:
        return ast.dump(node)
    text = f"Name(id={inner.id!r}, ctx=Load())"
    for attr in reversed(attrs):
        text = f"Attribute(value={text}, attr={attr!r}, ctx=Load())"
    return text
