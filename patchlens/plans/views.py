"""Test-data views: the driver tables re-shaped into the engine's inputs.

Each view is plain SQL that Spark and DuckDB both run unchanged (``CASE``, ``||``,
``regexp_extract``, ``chr``, integer ``%``; doubles are floored before any cast), so the
oracle rebuilds the same inputs independently. Every view reads its whole source table.
"""

from __future__ import annotations

Q = "chr(39)"  # a single quote, spelled so both SQL dialects read it the same way
NL = "chr(10)"
BS = "chr(92)"


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# statement kinds whose nodes carry a list ``body``
BODY_KINDS = ("If", "For", "While", "FunctionDef", "AsyncFunctionDef", "ClassDef", "Try", "With",
              "AsyncWith", "AsyncFor")

PALETTES = {
    "conditions": ("If", "Expr", "Pass"),
    "loops": ("For", "While", "Expr"),
    "assign": ("Assign", "AugAssign", "Expr"),
    "functions": ("FunctionDef", "AsyncFunctionDef", "Expr"),
    "imports": ("Import", "ImportFrom", "Expr"),
    "exceptions": ("Try", "Raise", "Expr"),
    "classes": ("ClassDef", "With", "Expr"),
    "literals": ("Constant", "JoinedStr", "Name"),
    "returns": ("Return", "Expr", "Pass"),
    "calls": ("Call", "Name", "Attribute"),
    "docstrings": ("With", "AsyncFunctionDef", "For", "If"),
    "attributes": ("Attribute", "Name", "Subscript"),
    "all": ("If", "For", "While", "Assign", "AugAssign", "FunctionDef", "ClassDef", "Import",
            "ImportFrom", "Try", "Raise", "Return", "With", "Expr"),
}

LIST_FIELDS = ("body_texts", "targets", "params", "names", "handlers", "decorators", "bases", "args")
NODE_VIEW_FIELDS = ("kind", "text", "test", "body_texts", "orelse_n", "target", "iter", "targets", "value",
                    "name", "params", "returns", "names", "module", "handlers", "exc", "decorators", "bases",
                    "const_str", "func_dump", "func_text", "args", "has_body", "docstring")


def _pick(idx: str, palette) -> str:
    whens = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(palette))
    return f"CASE {idx} {whens} END"


def _has_body(kind: str) -> str:
    return f"({kind} IN ({', '.join(repr(k) for k in BODY_KINDS)}))"


def node_pairs_sql(family: str) -> str:
    """Aligned statement slots from ``lineitem``: file = order, two functions per file by
    line parity, slot = row within the function by the unique 7-column order. Kinds come
    from a family palette; new-side facts change under independent data-driven flags,
    so every rule has firing and quiet rows. Lists are ``;``-joined strings ('' = empty)."""
    pal = PALETTES[family]
    k = len(pal)
    return f"""
SELECT pair_id, func, first_ord, pos,
  o_kind, o_text, o_test, o_body_texts, o_orelse_n, o_target, o_iter, o_targets, o_value, o_name, o_params,
  o_returns, o_names, o_module, o_handlers, o_exc, o_decorators, o_bases, o_const_str, o_func_dump, o_func_text,
  o_args, o_has_body, o_docstring,
  n_kind,
  n_kind || ': t' || {s("CASE WHEN f4 = 1 THEN (a + 1) % 11 ELSE a % 11 END")} AS n_text,
  'v' || {s("a % 7")} || CASE WHEN f1 = 1 THEN ' >= ' ELSE ' > ' END || {s("n")} AS n_test,
  o_body_texts || CASE WHEN f2 = 1 THEN ';z = ' || {s("n")} ELSE '' END AS n_body_texts,
  CAST(CASE WHEN f2 = 1 THEN 1 - o_orelse_n ELSE o_orelse_n END AS INT) AS n_orelse_n,
  CASE WHEN f3 = 1 THEN 'j' ELSE 'i' END || {s("n % 3")} AS n_target,
  'range(' || {s("q + f4")} || ')' AS n_iter,
  CASE WHEN f3 = 1 THEN 's' ELSE 't' END || {s("a % 4")}
    || CASE WHEN b % 5 = 0 THEN CASE WHEN f1 = 1 THEN ';w' ELSE ';u' END || {s("a % 4")} ELSE '' END AS n_targets,
  CASE WHEN f4 = 1 THEN 'x - ' || {s("q")} ELSE o_value END AS n_value,
  CASE WHEN f2 = 1 THEN 'm' ELSE 'n' END || {s("a % 6")} AS n_name,
  CASE WHEN f1 = 1 THEN 'a;b;c' ELSE o_params END AS n_params,
  CASE WHEN f4 = 1 THEN 'str' ELSE o_returns END AS n_returns,
  CASE WHEN f2 = 1 THEN 'os as p' ELSE o_names END AS n_names,
  CASE WHEN f3 = 1 THEN 'pkg' || {s("(a + 1) % 3")} ELSE o_module END AS n_module,
  CASE WHEN f1 = 1 THEN 'TypeError' ELSE o_handlers END AS n_handlers,
  CASE WHEN f4 = 1 THEN 'KeyError(' || {s("n")} || ')' ELSE o_exc END AS n_exc,
  CASE WHEN f2 = 1 THEN 'dec;cached' ELSE o_decorators END AS n_decorators,
  CASE WHEN f3 = 1 THEN o_bases || ';Mixin' ELSE o_bases END AS n_bases,
  CASE WHEN b % 7 = 0 OR f5 = 1 THEN NULL WHEN f4 = 1 THEN 'r' || {s("a % 9")} ELSE 's' || {s("a % 9")} END AS n_const_str,
  'Name(id=' || {Q} || CASE WHEN f3 = 1 THEN 'g' ELSE 'f' END || {s("a % 5")} || {Q} || ', ctx=Load())' AS n_func_dump,
  CASE WHEN f3 = 1 THEN 'g' ELSE 'f' END || {s("a % 5")} AS n_func_text,
  CASE WHEN f2 = 1 THEN 'x' ELSE 'x;y' END AS n_args,
  {_has_body("n_kind")} AS n_has_body,
  CASE WHEN {_has_body("n_kind")} AND (q % 2 = 0 OR f1 = 1) THEN 'doc ' || {s("(a + f2) % 3")} END AS n_docstring
FROM (
  SELECT base.*,
    {_pick(f"a % {k}", pal)} AS o_kind,
    {_pick(f"(a + kshift) % {k}", pal)} AS n_kind,
    {_pick(f"a % {k}", pal)} || ': t' || {s("a % 11")} AS o_text,
    'v' || {s("a % 7")} || ' > ' || {s("n")} AS o_test,
    'y = ' || {s("q")} AS o_body_texts,
    CAST(CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS INT) AS o_orelse_n,
    'i' || {s("n % 3")} AS o_target,
    'range(' || {s("q")} || ')' AS o_iter,
    't' || {s("a % 4")} || CASE WHEN b % 5 = 0 THEN ';u' || {s("a % 4")} ELSE '' END AS o_targets,
    CASE WHEN q % 10 = 0 THEN NULL ELSE 'x + ' || {s("q")} END AS o_value,
    'n' || {s("a % 6")} AS o_name,
    CASE WHEN q % 7 = 0 THEN '' ELSE 'a;b' END AS o_params,
    CASE WHEN q % 3 = 0 THEN NULL ELSE 'int' END AS o_returns,
    CASE WHEN n % 2 = 0 THEN 'os' ELSE 'os as o;sys' END AS o_names,
    CASE WHEN n % 4 = 0 THEN NULL ELSE 'pkg' || {s("a % 3")} END AS o_module,
    CASE WHEN b % 2 = 0 THEN 'ValueError' ELSE 'None;KeyError' END AS o_handlers,
    CASE WHEN q % 5 = 0 THEN NULL ELSE 'ValueError(' || {s("n")} || ')' END AS o_exc,
    CASE WHEN a % 3 = 0 THEN '' ELSE 'dec' END AS o_decorators,
    'Base' || {s("a % 4")} AS o_bases,
    CASE WHEN b % 7 = 0 THEN NULL ELSE 's' || {s("a % 9")} END AS o_const_str,
    'Name(id=' || {Q} || 'f' || {s("a % 5")} || {Q} || ', ctx=Load())' AS o_func_dump,
    'f' || {s("a % 5")} AS o_func_text,
    'x;y' AS o_args,
    {_has_body(_pick(f"a % {k}", pal))} AS o_has_body,
    CASE WHEN {_has_body(_pick(f"a % {k}", pal))} AND q % 2 = 0 THEN 'doc ' || {s("a % 3")} END AS o_docstring
  FROM (
    SELECT {s("l_orderkey")} AS pair_id,
      'fn' || {s("l_linenumber % 2")} AS func,
      CAST(CASE WHEN l_orderkey % 2 = l_linenumber % 2 THEN 0 ELSE 1 END AS INT) AS first_ord,
      CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS pos,
      l_partkey AS a, l_suppkey AS b,
      CAST(FLOOR(l_quantity) AS BIGINT) AS q,
      CAST(l_linenumber AS BIGINT) AS n,
      CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS f1,
      CASE WHEN CAST(FLOOR(l_quantity) AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS f2,
      CASE WHEN l_partkey % 5 < 2 THEN 1 ELSE 0 END AS f3,
      CASE WHEN CAST(FLOOR(l_extendedprice) AS BIGINT) % 3 = 1 THEN 1 ELSE 0 END AS f4,
      CASE WHEN (l_partkey + l_suppkey) % 7 = 0 THEN 1 ELSE 0 END AS f5,
      CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS kshift
    FROM lineitem
  ) base
) nodes
"""


def _expression_rows_sql() -> str:
    """A function for each ``lineitem`` row, with what changes in it: f1 a string, f2 a formatted string and an
    attribute deep in a call, f3 a callee, f4 a number among arguments, f5 an attribute."""
    q = "CAST(FLOOR(l_quantity) AS BIGINT)"
    flag = lambda c, k: f"CASE WHEN {c} THEN 1 ELSE 0 END AS f{k}"
    return f"""
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS place,
  {q} AS q, CAST(l_linenumber AS BIGINT) AS n, l_partkey % 5 AS a,
  {flag("l_suppkey % 3 = 0", 1)}, {flag(f"{q} % 4 = 0", 2)}, {flag("l_partkey % 7 < 2", 3)}, {flag("l_suppkey % 5 = 1", 4)}, {flag("l_partkey % 2 = 0", 5)}
FROM lineitem
"""


def expression_sides_sql() -> str:
    """Texts of the expressions on both sides (``o_``, ``n_``) of every function."""
    def both(name: str, expr) -> str:
        old = expr(*["0"] * 5)
        new = expr(*[f"f{k}" for k in range(1, 6)])
        return f"{old} AS o_{name}, {new} AS n_{name}"

    t = lambda e: s(e)
    return f"""
SELECT *, {both("s", lambda f1, f2, f3, f4, f5: f"'a' || {t(f'q + {f1}')}")},
  {both("f", lambda f1, f2, f3, f4, f5: f"'f' || {Q} || '{{x}} ' || {t(f'n + {f2}')} || {Q}")},
  {both("g", lambda f1, f2, f3, f4, f5: f"'g' || {t(f'a + {f3}')}")}, {both("i", lambda f1, f2, f3, f4, f5: t(f"q + {f4}"))},
  {both("v", lambda f1, f2, f3, f4, f5: f"'x.attr' || {t(f'a + {f5}')}")}, {both("k", lambda f1, f2, f3, f4, f5: f"'k' || {t(f'n + {f1}')}")},
  {both("p", lambda f1, f2, f3, f4, f5: f"'x.p.q' || {t(f'q + {f2}')}")}
FROM ({_expression_rows_sql()}) e
"""


def expression_items_sql(dialect: str) -> str:
    """One item per order: both versions of a Python file whose functions differ within statements only."""
    def block(side: str) -> str:
        line = lambda text: f"'    ' || {text} || {NL}"
        return " || ".join(["'def fn_' || " + s("place") + " || '(x):' || " + NL, line(f"'s = ' || {Q} || {side}_s || {Q}"), line(f"'t = ' || {side}_f"),
                            line(f"'u = ' || {side}_g || '(x, ' || {side}_i || ')'"), line(f"'v = ' || {side}_v"),
                            line(f"'return h(' || {Q} || {side}_k || {Q} || ', ' || {side}_p || ')'")])

    def joined(side: str) -> str:
        if dialect == "spark":
            return f"array_join(transform(array_sort(collect_list(struct(place, {block(side)} AS block))), x -> x.block), {NL})"
        return f"string_agg({block(side)}, {NL} ORDER BY place)"
    return f"SELECT {s('l_orderkey')} AS pair_id, {joined('o')} AS old, {joined('n')} AS new FROM ({expression_sides_sql()}) e GROUP BY l_orderkey"


def functions_sql() -> str:
    """Function rows from ``orders``: file = customer, name from the order key (names
    repeat inside a file, so last-wins matters), version by order-key parity, walk order =
    order key, body = status and priority."""
    return f"""
SELECT {s("o_custkey")} AS pair_id, CAST(o_orderkey % 2 AS INT) AS version,
  'f_' || {s("o_orderkey % 7")} AS func, CAST(o_orderkey AS BIGINT) AS walk_ord,
  o_orderstatus || '-' || o_orderpriority AS body
FROM orders
"""


def _block_sql() -> str:
    """One function definition per ``lineitem`` row (Python source, already canonical)."""
    d = "CAST(FLOOR(l_discount * 100) AS BIGINT)"
    t = "CAST(FLOOR(l_tax * 100) AS BIGINT)"
    q = "CAST(FLOOR(l_quantity) AS BIGINT)"
    return f"""
SELECT l_orderkey,
  CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS pos,
  'f_' || {s("l_linenumber % 4")} AS fname,
  CASE WHEN {q} % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS fargs,
  l_linenumber % 3 = 0 AS nested,
  'def g_' || {s("l_linenumber")} || '(y):' AS gdef,
  'return y * ' || {s(q)} AS gret,
  'x = ' || {s(q)} AS s_assign,
  'if x > ' || {s(d)} || ':' || {NL} || '    return x - ' || {s(t)} AS s_if,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND {q} = 50 THEN 'return x +'
       ELSE 'return x + ' || {s(t)} END AS s_ret,
  {q} AS q, {d} AS d, {t} AS t
FROM lineitem
"""


def source_blocks_sql() -> str:
    """Per row: the definition's source text (nested helper for every third line number)."""
    return f"""
SELECT l_orderkey, pos, fname, fargs, nested, gdef, gret, s_assign, s_if, s_ret,
  'def ' || fname || '(' || replace(fargs, ',', ', ') || '):' || {NL}
    || '    ' || s_assign || {NL}
    || CASE WHEN nested THEN '    ' || gdef || {NL} || '        ' || gret || {NL} ELSE '' END
    || '    if x > ' || {s("d")} || ':' || {NL} || '        return x - ' || {s("t")} || {NL}
    || '    ' || s_ret AS block
FROM ({_block_sql()}) blocks
"""


def sources_sql(dialect: str) -> str:
    """One Python file per order: its definitions in row order, blank line between."""
    if dialect == "spark":
        body = f"array_join(transform(array_sort(collect_list(struct(pos, block))), x -> x.block), {NL} || {NL})"
    else:
        body = f"string_agg(block, {NL} || {NL} ORDER BY pos)"
    return f"""
SELECT {s("l_orderkey")} AS pair_id, {body} AS source
FROM ({source_blocks_sql()}) sb
GROUP BY l_orderkey
"""


def odd_sources_sql() -> str:
    """A Python file for each ``part``, not in canonical form: a method with parameters of every kind, an ``async def`` that holds
    a plain one, comments, odd spacing and brackets, a lambda."""
    n = s("p_size")
    lines = ["'class C:'", "'    def m_' || " + s("p_partkey % 5") + " || '(self,p ,/, q=1, *rest, key = 2, **more):'", f"'        x=( q+' || {n} || ' )  # note'",
             "'        return   x'", "''", "'async def a(y):'", f"'    def inner(z): return  [ z , ' || {n} || ' ]'", "'    return y'", "'lam = lambda t: t'"]
    return f"SELECT {s('p_partkey')} AS pair_id, {f' || {NL} || '.join(lines)} AS source FROM part"


def explanation_sql(k: str) -> str:
    """The explanation that order ``k``'s reply gives for its change."""
    return f"""CASE WHEN {k} % 3 = 0 THEN 'Value of variable x changed; the assignment now adds one.'
    WHEN {k} % 3 = 1 AND {k} % 5 = 0 THEN 'Function: change of type return_change detected, change of type return_value_change detected.'
    WHEN {k} % 3 = 1 THEN 'The return value changed: subtraction instead of addition.'
    WHEN {k} % 2 = 0 THEN 'A condition now holds for equal values too.'
    ELSE 'No functional change.' END"""


def doc_pairs_sql() -> str:
    """Each document against a revision of itself: first line moved to the end and one line
    added, so slots differ, lines move and a tail appears. Statement = line."""
    cut = f"instr(text, {NL})"
    return f"""
SELECT {s("doc_id")} AS pair_id, text AS old_text,
  CASE WHEN {cut} > 0 THEN substr(text, {cut} + 1) || {NL} || substr(text, 1, {cut} - 1) ELSE text END
    || {NL} || 'Added, ' || lang || ' ' || source AS new_text
FROM documents
"""


def text_pairs_sql() -> str:
    """Neighbouring documents as (summary, explanation) pairs for scoring."""
    return """
SELECT CAST(d1.doc_id AS STRING) AS pair_id, d1.text AS summary, d2.text AS explanation
FROM documents d1 JOIN documents d2 ON d2.doc_id = d1.doc_id + 1
"""


def document_summaries_sql() -> str:
    """Whole documents as summaries."""
    return f"SELECT {s('doc_id')} AS pair_id, text AS summary FROM documents"


def conversation_explanations_sql(dialect: str) -> str:
    """Whole conversations as explanations: all turns in their order, a line each."""
    if dialect == "spark":
        body = f"array_join(transform(array_sort(collect_list(struct(turn, coalesce(text, '') AS text))), x -> x.text), {NL})"
    else:
        body = f"string_agg(coalesce(text, ''), {NL} ORDER BY turn, coalesce(text, ''))"
    return f"SELECT {s('conv_id')} AS pair_id, {body} AS explanation FROM conversations GROUP BY conv_id"


def stored_records_sql() -> str:
    """One record a ``lineitem`` row, its type by turns: the template kinds and one without a template."""
    q = "CAST(FLOOR(l_quantity) AS BIGINT)"
    kinds = ("statement_reordered", "function_added", "var_rename", "condition_change", "condition_added", "var_value_change", "loop_change")
    cases = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(kinds))
    return f"""
SELECT {s("l_orderkey")} || '-' || {s("l_linenumber")} || '-' || {s("l_partkey")} AS id, CASE {q} % 7 {cases} END AS type,
  'f_' || {s("l_linenumber")} AS function, 'v' || {s(q)} AS target, 'a' || {s(q)} AS old, 'b' || {s(q)} AS new,
  'x > ' || {s(q)} AS condition, 'call(' || {s(q)} || ')' AS statement,
  CAST(l_linenumber AS INT) AS old_position, CAST(l_linenumber + 1 AS INT) AS new_position
FROM lineitem
"""


def vector_pairs_sql() -> str:
    """Neighbouring vectors, each vector with itself, and some without a partner: both
    verdicts and a reason for a missing score occur."""
    return """
SELECT CAST(e1.vec_id AS STRING) AS pair_id, e1.embedding AS left_vec, e2.embedding AS right_vec
FROM embeddings e1 JOIN embeddings e2 ON e2.vec_id = e1.vec_id + 1
UNION ALL SELECT CAST(vec_id AS STRING) || '-self', embedding, embedding FROM embeddings
UNION ALL SELECT CAST(vec_id AS STRING) || '-none', embedding, NULL FROM embeddings WHERE vec_id % 7 = 0
"""


# six vector "models" over the embeddings: (name, 1-based start, width)
VECTOR_MODELS = (("slice4_a", 1, 4), ("slice4_b", 5, 4), ("slice8_a", 9, 8), ("slice8_b", 17, 8),
                 ("slice16", 25, 16), ("full64", 1, 64))


def replies_sql() -> str:
    """Model replies from assistant turns, in every shape the parser must handle; the user turn
    before a reply is its source (empty if there is none)."""
    body = "text"
    expl = f"'  Changed: ' || {body} || '  '"
    delim = "'---EXPLANATION---'"
    fence = "'```'"
    return f"""
SELECT {s("conv_id")} || '-' || {s("turn")} AS pair_id, source,
  CASE
    WHEN length(text) % 7 = 0 THEN 'NO BUGS FOUND'
    WHEN length(text) % 7 = 1 THEN 'NO BUGS FOUND' || {NL}
    WHEN length(text) % 11 = 0 THEN {body}
    WHEN length(text) % 5 = 0 THEN 'Fixed Code:' || {NL} || {fence} || 'python' || {NL} || {body} || {NL} || {fence}
      || {NL} || {delim} || {NL} || {expl}
    WHEN length(text) % 5 = 1 THEN {fence} || {NL} || {body} || {fence} || {delim} || {expl}
    WHEN length(text) % 5 = 2 THEN '  ' || {fence} || 'python' || {NL} || {body} || {NL} || {fence} || {delim} || {expl}
    WHEN length(text) % 5 = 3 THEN 'fixed code: ' || {body} || {delim} || {expl} || {delim} || 'second part'
    ELSE {body} || {NL} || {delim} || {NL} || {expl}
  END AS reply
FROM (SELECT a.conv_id, a.turn, a.text, coalesce(u.text, '') AS source
  FROM (SELECT * FROM conversations WHERE role = 'assistant') a
  LEFT JOIN (SELECT conv_id, turn + 1 AS next_turn, max(text) AS text FROM conversations WHERE role = 'user'
             GROUP BY conv_id, turn + 1) u
  ON u.conv_id = a.conv_id AND u.next_turn = a.turn) turns
"""


def _url_path(with_query: bool) -> str:
    tail = "[^#]*" if with_query else "[^?#]*"
    return f"regexp_extract(url, '^[a-z]+://[^/]+(/{tail})', 1)"


def items_sql() -> str:
    """Items from ``part``: project from the key, bug id = part key."""
    return f"SELECT 'proj' || {s('p_partkey % 17')} AS project, p_partkey AS bug_id FROM part"


def patches_sql(rows: str = "pages", key: str = "page_id") -> str:
    """Patch texts from ``pages``: the first line's shape depends on the URL (not a diff,
    no ``b/`` token, backslash separators, plain); the path keeps the query string."""
    rel = f"'src' || replace(replace(replace({_url_path(True)}, '?', '_'), '=', '_'), '&', '_') || '.py'"
    return f"""
SELECT 'proj' || {s(f"({key} * 3 + 1) % 17")} AS project, {key} * 3 + 1 AS bug_id,
  CASE
    WHEN url LIKE '%.org/%' THEN 'index ' || {rel}
    WHEN url LIKE 'https://m.%' THEN 'diff --git a/' || {rel}
    WHEN url LIKE 'http://%' THEN 'diff --git a/' || {rel} || ' b/' || replace({rel}, '/', {BS})
    ELSE 'diff --git a/' || {rel} || ' b/' || {rel}
  END || {NL} || 'index 0000000..1111111 100644' || {NL} || '--- a/' || {rel} AS patch
FROM {rows}
"""


def files_sql() -> str:
    """Checked-out buggy files from ``pages`` (path without the query string)."""
    proj = f"'proj' || {s('(page_id * 3 + 1) % 17')}"
    return f"""
SELECT {proj} || '/' || {s("page_id * 3 + 1")} || '/buggy/' || {proj} || '/src' || {_url_path(False)} || '.py'
  AS path, html AS source
FROM pages
"""


#: Pages whose functions make one file of the checkout tree.
TREE_PAGES = 20


def tree_groups_sql(dialect: str) -> str:
    """``g`` with the first page's URL, a Python file of one function a page, the same with every value one more, and the pages' markup."""
    code = lambda n: (f"'def page_' || {s('page_id')} || '(x):' || {NL} || '    y = x + ' || {s(n)} || {NL} || '    if y > 3:' || {NL}"  # noqa: E731
                      f" || '        return x' || {NL} || '    return y' || {NL}")

    def joined(text: str) -> str:
        if dialect == "spark":
            return f"array_join(transform(array_sort(collect_list(struct(page_id, {text} AS t))), x -> x.t), {NL})"
        return f"string_agg({text}, {NL} ORDER BY page_id)"
    return f"""
SELECT page_id - page_id % {TREE_PAGES} AS g, min_by(url, page_id) AS url, {joined(code('page_id'))} AS code, {joined(code('page_id + 1'))} AS fixed,
  {joined("coalesce(html, '')")} AS html
FROM pages GROUP BY page_id - page_id % {TREE_PAGES}
"""


def tree_files_sql(dialect: str) -> str:
    """Files of a checkout tree: every third item's file holds markup, the others Python functions; each folder has a second
    file that no diff names, and there are folders that are no bugs."""
    project, bug = f"'proj' || {s('(g * 3 + 1) % 17')}", s("g * 3 + 1")
    groups = tree_groups_sql(dialect)
    return f"""
SELECT {project} || '/' || {bug} || '/buggy/' || {project} || '/src' || {_url_path(False)} || '.py' AS path,
  CASE WHEN g % 3 = 0 THEN html ELSE code END AS text FROM ({groups}) a
UNION ALL SELECT {project} || '/' || {bug} || '/buggy/' || {project} || '/unnamed.py' AS path, 'x = 1' AS text FROM ({groups}) b
UNION ALL SELECT {project} || '/notes/buggy/' || {project} || '/page' || {s("g")} || '.py' AS path, html AS text FROM ({groups}) c
"""


def tree_patches_sql(dialect: str) -> str:
    """Diffs of a checkout tree, in the shapes of ``patches_sql``; every ninth item has none."""
    return patches_sql(f"({tree_groups_sql(dialect)}) g WHERE g % 9 <> 0", "g")


def tree_replies_sql(dialect: str) -> str:
    """Replies for a checkout tree: by turns changed values, the sentinel, one without a delimiter, code that does not
    parse, and none at all."""
    fence = "'```'"
    return f"""
SELECT 'proj' || {s('(g * 3 + 1) % 17')} AS project, g * 3 + 1 AS bug_id,
  CASE WHEN g % 7 = 0 THEN 'NO BUGS FOUND' WHEN g % 7 = 1 THEN fixed
    WHEN g % 7 = 2 THEN 'def page(:' || '---EXPLANATION---' || 'broken'
    ELSE {fence} || 'python' || {NL} || fixed || {fence} || '---EXPLANATION---' || 'The value of y is one more.' END AS reply
FROM ({tree_groups_sql(dialect)}) r WHERE g % 11 <> 0
"""


def projects_sql() -> str:
    return f"SELECT lower(replace(p_brand, '#', '')) || '_' || {s('p_partkey')} AS project, p_size AS n_bugs FROM part"
