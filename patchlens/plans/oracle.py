"""DuckDB SQL for every registered query, written independently of the engine code.

The inputs are the same views (``views.py``); the operator logic is re-stated here in
plain SQL: rules as a ``UNION ALL`` of filtered selects, ordering with window functions,
text assembly with ``string_agg``.
"""

from __future__ import annotations

from ..operators.encoder import FEATURES
from . import views as V

WS = r"[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


# ------------------------------------------------------------------ diff rules

_CHAIN1 = ("If", "For", "Assign", "FunctionDef", "Import", "ImportFrom", "Try", "Raise", "ClassDef",
           "Constant", "JoinedStr", "Return")
_CHAIN2 = ("Call", "Assign", "If", "For", "While", "FunctionDef", "ClassDef", "Return", "Try")


def _in(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_OUT = ("function", "target", "cls", "module", "old", "new", "old_list", "new_list", "cond", "body")
_D = "IS DISTINCT FROM"
_E = "IS NOT DISTINCT FROM"
_T1 = "split_part(o_targets, ';', 1)"
_T1N = "split_part(n_targets, ';', 1)"

# (rule, type, where, payload)
_RULE_SQL = [
    ("R01", "condition_added", "b1 = 'if_added'", dict(function="func", cond="n_test", body="n_body_texts")),
    ("R02", "condition_change", f"b1 = 'If' AND o_test {_D} n_test",
     dict(target="split_part(n_test, ' ', 1)", old="o_test", new="n_test")),
    ("R03", "else_block_change", "b1 = 'If' AND (o_orelse_n > 0 OR n_orelse_n > 0)", dict(function="func")),
    ("R04", "loop_change", f"b1 = 'For' AND (o_target {_D} n_target OR o_iter {_D} n_iter)",
     dict(target="'for ' || n_target || ' in ' || n_iter", old="'for ' || o_target || ' in ' || o_iter",
          new="'for ' || n_target || ' in ' || n_iter")),
    ("R05", "var_rename", f"b1 = 'Assign' AND {_T1} {_D} {_T1N} AND o_value {_E} n_value", dict(old=_T1, new=_T1N)),
    ("R06", "var_value_change", f"b1 = 'Assign' AND {_T1} {_E} {_T1N} AND o_value {_D} n_value",
     dict(target=_T1, old="o_value", new="n_value")),
    ("R07", "param_change", f"b1 = 'FunctionDef' AND o_params {_D} n_params",
     dict(function="o_name", old_list="o_params", new_list="n_params")),
    ("R08", "return_type_change", f"b1 = 'FunctionDef' AND o_returns {_D} n_returns",
     dict(function="o_name", old="o_returns", new="n_returns")),
    ("R09", "import_change", f"b1 = 'Import' AND o_names {_D} n_names", dict(old_list="o_names", new_list="n_names")),
    ("R10", "import_from_change", f"b1 = 'ImportFrom' AND (o_module {_D} n_module OR o_names {_D} n_names)",
     dict(module="n_module", old_list="o_names", new_list="n_names")),
    ("R11", "exception_handler_change", f"b1 = 'Try' AND o_handlers {_D} n_handlers",
     dict(old_list="o_handlers", new_list="n_handlers")),
    ("R12", "raise_change", f"b1 = 'Raise' AND o_exc {_D} n_exc", dict(old="o_exc", new="n_exc")),
    ("R13", "class_decorator_change", f"b1 = 'ClassDef' AND o_decorators {_D} n_decorators",
     dict(cls="o_name", old_list="o_decorators", new_list="n_decorators")),
    ("R14", "class_inheritance_change", f"b1 = 'ClassDef' AND o_bases {_D} n_bases",
     dict(cls="o_name", old_list="o_bases", new_list="n_bases")),
    ("R15", "string_change",
     "b1 = 'Constant' AND o_const_str IS NOT NULL AND n_const_str IS NOT NULL AND o_const_str <> n_const_str",
     dict(old="o_const_str", new="n_const_str")),
    ("R16", "fstring_change", f"b1 = 'JoinedStr' AND o_text {_D} n_text", dict(old="o_text", new="n_text")),
    ("R17", "return_change", f"b1 = 'Return' AND o_value {_D} n_value",
     dict(old="o_value", new="n_value", function="func")),
    ("R18", "function_call_change", f"b2 = 'Call' AND o_func_dump {_D} n_func_dump",
     dict(old="o_func_text", new="n_func_text")),
    ("R19", "function_arguments_change", f"b2 = 'Call' AND o_args {_D} n_args",
     dict(old_list="o_args", new_list="n_args")),
    ("R20", "assignment_target_change", f"b2 = 'Assign' AND o_targets {_D} n_targets",
     dict(old_list="o_targets", new_list="n_targets")),
    ("R21", "assignment_value_change", f"b2 = 'Assign' AND o_value {_D} n_value", dict(old="o_value", new="n_value")),
    ("R22", "if_condition_change", f"b2 = 'If' AND o_test {_D} n_test", dict(old="o_test", new="n_test")),
    ("R23", "for_loop_target_change", f"b2 = 'For' AND o_target {_D} n_target", dict(old="o_target", new="n_target")),
    ("R24", "for_loop_iterable_change", f"b2 = 'For' AND o_iter {_D} n_iter", dict(old="o_iter", new="n_iter")),
    ("R25", "while_condition_change", f"b2 = 'While' AND o_test {_D} n_test", dict(old="o_test", new="n_test")),
    ("R26", "function_name_change", f"b2 = 'FunctionDef' AND o_name {_D} n_name", dict(old="o_name", new="n_name")),
    ("R27", "function_arguments_change", f"b2 = 'FunctionDef' AND o_params {_D} n_params",
     dict(old_list="o_params", new_list="n_params")),
    ("R28", "class_name_change", f"b2 = 'ClassDef' AND o_name {_D} n_name", dict(old="o_name", new="n_name")),
    ("R29", "class_base_change", f"b2 = 'ClassDef' AND o_bases {_D} n_bases",
     dict(old_list="o_bases", new_list="n_bases")),
    ("R30", "return_value_change", f"b2 = 'Return' AND o_value {_D} n_value", dict(old="o_value", new="n_value")),
    ("R31", "exception_handler_change", f"b2 = 'Try' AND o_handlers {_D} n_handlers",
     dict(old_list="o_handlers", new_list="n_handlers")),
    ("R33", "docstring_change",
     "b2 = 'body' AND o_docstring IS NOT NULL AND n_docstring IS NOT NULL AND o_docstring <> n_docstring",
     dict(old="o_docstring", new="n_docstring")),
    ("R34", "attribute_assignment_change", f"b2 = 'Attribute' AND o_text {_D} n_text", dict(old="o_text", new="n_text")),
    ("R35", "augmented_assignment_change", f"b2 = 'AugAssign' AND o_text {_D} n_text", dict(old="o_text", new="n_text")),
]

# JSON key order per rule for the change-set form (after "type")
_JSON_KEYS = {
    "R01": ("condition:cond", "body:body[]", "function"), "R02": ("target", "old", "new"), "R03": ("function",),
    "R04": ("target", "old", "new"), "R05": ("old", "new"), "R06": ("target", "old", "new"),
    "R07": ("function", "old:old_list[]", "new:new_list[]"), "R08": ("function", "old", "new"),
    "R09": ("old:old_list[]", "new:new_list[]"), "R10": ("module", "old:old_list[]", "new:new_list[]"),
    "R11": ("old:old_list[]", "new:new_list[]"), "R12": ("old", "new"),
    "R13": ("class:cls", "old:old_list[]", "new:new_list[]"), "R14": ("class:cls", "old:old_list[]", "new:new_list[]"),
    "R15": ("old", "new"), "R16": ("old", "new"), "R17": ("old", "new", "function"),
    "R18": ("old", "new"), "R19": ("old:old_list[]", "new:new_list[]"), "R20": ("old:old_list[]", "new:new_list[]"),
    "R21": ("old", "new"), "R22": ("old", "new"), "R23": ("old", "new"), "R24": ("old", "new"), "R25": ("old", "new"),
    "R26": ("old", "new"), "R27": ("old:old_list[]", "new:new_list[]"), "R28": ("old", "new"),
    "R29": ("old:old_list[]", "new:new_list[]"), "R30": ("old", "new"), "R31": ("old:old_list[]", "new:new_list[]"),
    "R33": ("old", "new"), "R34": ("old", "new"), "R35": ("old", "new"),
}


def _list_json(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = '' THEN '[]'::JSON ELSE to_json(string_split({x}, ';')) END)"


def diff_rows_sql(family: str, rules=None) -> str:
    """CTE chain ending in ``rows``: one row per change, with ``seq`` and ``first_ord``."""
    b1 = (f"CASE WHEN n_kind = 'If' AND o_kind <> 'If' THEN 'if_added' "
          f"WHEN o_kind = n_kind AND o_kind IN {_in(_CHAIN1)} THEN o_kind END")
    b2 = (f"CASE WHEN o_kind = n_kind AND o_kind IN {_in(_CHAIN2)} THEN o_kind "
          f"WHEN o_has_body AND n_has_body THEN 'body' "
          f"WHEN o_kind = n_kind AND o_kind IN ('Attribute', 'AugAssign') THEN o_kind END")
    sels = []
    for rk, (rule, type_, where, payload) in enumerate(rules or _RULE_SQL):
        vals = ", ".join(f"CAST({payload.get(c, 'NULL')} AS VARCHAR) AS {c}" for c in _OUT)
        sels.append(f"SELECT pair_id, func, first_ord, pos, {rk} AS rk, '{rule}' AS rule, '{type_}' AS type, "
                    f"{vals} FROM b WHERE {where}")
    union = "\n  UNION ALL ".join(sels)
    return f"""np AS ({V.node_pairs_sql(family)}),
b AS (SELECT *, {b1} AS b1, {b2} AS b2 FROM np),
r AS ({union}),
rows AS (SELECT *, row_number() OVER (PARTITION BY pair_id, func, pos ORDER BY rk) - 1 AS seq FROM r)"""


def diff_sql(family: str, rules=None) -> str:
    return f"""WITH {diff_rows_sql(family, rules)}
SELECT pair_id, func, CAST(pos AS BIGINT) AS pos, CAST(seq AS BIGINT) AS seq, rule, type, function, target, cls,
  module, old, new, old_list, new_list, cond, body
FROM rows"""


def _json_obj() -> str:
    whens = []
    for rule, keys in _JSON_KEYS.items():
        args = ["'type', type"]
        for k in keys:
            name, _, col = k.partition(":")
            col = col or name
            if col.endswith("[]"):
                args.append(f"'{name}', {_list_json(col[:-2])}")
            else:
                args.append(f"'{name}', {col}")
        whens.append(f"WHEN '{rule}' THEN json_object({', '.join(args)})::VARCHAR")
    return "CASE rule " + " ".join(whens) + " END"


def changes_json_sql() -> str:
    return f"""WITH {diff_rows_sql("all")},
j AS (SELECT pair_id, func, first_ord, pos, seq, {_json_obj()} AS js FROM rows),
f AS (SELECT pair_id, func, first_ord, count(*) AS n,
        '"' || func || '":[' || string_agg(js, ',' ORDER BY pos, seq) || ']' AS fj
      FROM j GROUP BY pair_id, func, first_ord)
SELECT pair_id, CAST(count(*) AS BIGINT) AS n_functions, CAST(sum(n) AS BIGINT) AS n_changes,
  '{{' || string_agg(fj, ',' ORDER BY first_ord, func) || '}}' AS changes_json
FROM f GROUP BY pair_id"""


def _roundtrip_val(field: str) -> str:
    lists = [r for r, keys in _JSON_KEYS.items() if f"{field}:{field}_list[]" in keys]
    return (f"CASE WHEN rule IN {_in(lists)} THEN {_list_json(field + '_list')}::VARCHAR ELSE {field} END")


def changes_roundtrip_sql() -> str:
    return f"""WITH {diff_rows_sql("all")}
SELECT pair_id, func, CAST(row_number() OVER (PARTITION BY pair_id, func ORDER BY pos, seq) - 1 AS BIGINT) AS idx,
  type, {_roundtrip_val("old")} AS old, {_roundtrip_val("new")} AS new,
  CASE WHEN rule IN ('R01', 'R03', 'R07', 'R08', 'R17', 'R32') THEN function END AS function,
  CASE WHEN rule IN ('R02', 'R04', 'R06') THEN target END AS target
FROM rows"""


def _sentence(cond: str = "cond", moved: bool = False) -> str:
    # fixed values: the sentences' wording
    q = "''"
    c = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'None')" if moved or x not in ("statement", "old_position", "new_position") else "''"
    return f"""CASE type
  WHEN 'var_rename' THEN 'Variable {q}' || {c('old')} || '{q} was renamed to {q}' || {c('new')} || '{q}.'
  WHEN 'var_value_change' THEN 'Value of variable {q}' || {c('target')} || '{q} changed from {q}' || {c('old')}
    || '{q} to {q}' || {c('new')} || '{q}.'
  WHEN 'condition_change' THEN 'Condition changed from {q}' || {c('old')} || '{q} to {q}' || {c('new')} || '{q}.'
  WHEN 'condition_added' THEN 'A new condition {q}' || {c(cond)} || '{q} was added in function {q}'
    || {c('function')} || '{q}.'
  WHEN 'statement_reordered' THEN 'Statement {q}' || {c('statement')} || '{q} moved from line ' || {c('old_position')}
    || ' to ' || {c('new_position')} || ' in function {q}' || {c('function')} || '{q}.'
  WHEN 'function_added' THEN 'Function {q}' || {c('function')} || '{q} was added.'
  ELSE 'Change of type {q}' || type || '{q} detected.' END"""


def render_sentences_sql() -> str:
    return f"""WITH {diff_rows_sql("all")}
SELECT pair_id, func, CAST(pos AS BIGINT) AS pos, CAST(seq AS BIGINT) AS seq, type, {_sentence()} AS sentence
FROM rows"""


def render_all_types_sql() -> str:
    return f"SELECT id, type, {_sentence('condition', True)} AS sentence FROM ({V.stored_records_sql()}) r"


def diff_strict_sql() -> str:
    """Strict mode adds the decorators of functions; the views hold no else texts, so equal else
    parts are equal and R03 never fires."""
    strict = [(r, t, w, p) for r, t, w, p in _RULE_SQL if r != "R03"]
    at = [r for r, *_ in strict].index("R28")
    strict.insert(at, ("R32", "function_decorator_change", f"b2 = 'FunctionDef' AND o_decorators {_D} n_decorators",
                       dict(function="o_name", old_list="o_decorators", new_list="n_decorators")))
    return diff_sql("all", strict)


def score_pairs_sql() -> str:
    return score_lexical_sql(f"SELECT s.pair_id, summary, explanation FROM ({V.document_summaries_sql()}) s "
                             f"JOIN ({V.conversation_explanations_sql('duckdb')}) e ON e.pair_id = s.pair_id")


def _hashed_sql(features: int) -> str:
    """CTEs: ``idf`` with the buckets' weights over whole ``documents``, ``total`` with the number of texts."""
    return f"""dt AS (SELECT doc_id, lower({_strip('text')}) AS t FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {features} AS bucket FROM (SELECT doc_id, unnest({_words('t')}) AS w FROM dt) x),
total AS (SELECT count(*) AS n FROM dt),
idf AS (SELECT bucket, ln((n + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)) AS weight FROM dw, total GROUP BY bucket, n)"""


def encode_hashed_sql() -> str:
    return f"""WITH {_hashed_sql(FEATURES)},
c AS (SELECT doc_id, bucket, count(*) AS n FROM dw GROUP BY ALL),
v AS (SELECT doc_id, string_agg(CAST(c.bucket AS VARCHAR) || ':' || CAST(c.n AS VARCHAR), ',' ORDER BY c.bucket) AS counts,
        count(*) AS n_indices, sqrt(sum(n * weight * n * weight)) AS norm FROM c JOIN idf ON idf.bucket = c.bucket GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(n_indices, 0) END AS BIGINT) AS n_indices,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(regexp_replace(counts, ':[0-9]+', '', 'g'), '')) END AS indices_md5,
  CASE WHEN d.text IS NOT NULL THEN round(coalesce(norm, 0), 4) END AS norm
FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id"""


def score_hashed_idf_sql() -> str:
    """Pairs of neighbouring documents by weighted buckets."""
    side = lambda c: (f"SELECT pair_id, '{c}' AS side, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {FEATURES} AS bucket "  # noqa: E731
                      f"FROM (SELECT pair_id, unnest({_words(f'lower({_strip(c)})')}) AS w FROM tp) x")
    return f"""WITH {_hashed_sql(FEATURES)}, tp AS ({V.text_pairs_sql()}),
b AS ({side('summary')} UNION ALL {side('explanation')}),
c AS (SELECT pair_id, bucket, count(*) FILTER (side = 'summary') AS x, count(*) FILTER (side = 'explanation') AS y FROM b GROUP BY ALL),
s AS (SELECT pair_id, sum(x * y * weight * weight) AS dot, sum(x * x * weight * weight) AS na, sum(y * y * weight * weight) AS nb
      FROM (SELECT c.*, coalesce(idf.weight, ln(n + 1)) AS weight FROM c LEFT JOIN idf ON idf.bucket = c.bucket, total) z GROUP BY pair_id),
r AS (SELECT tp.pair_id, CASE WHEN na > 0 AND nb > 0 THEN dot / (sqrt(na) * sqrt(nb)) END AS score FROM tp LEFT JOIN s ON s.pair_id = tp.pair_id)
SELECT pair_id, 'hashed_idf' AS model, round(score, 4) AS score, CASE WHEN score IS NOT NULL THEN format('{{:.2f}}', score) END AS shown,
  coalesce(score >= 0.6, false) AS is_match, CASE WHEN score IS NULL THEN 'empty_text' END AS error FROM r"""


def summary_text_sql() -> str:
    return f"""WITH {diff_rows_sql("all")},
s AS (SELECT pair_id, func, first_ord, pos, seq, {_sentence()} AS sentence FROM rows),
f AS (SELECT pair_id, func, first_ord,
        'Function: ' || func || chr(10) || string_agg('- ' || sentence || chr(10), '' ORDER BY pos, seq) || chr(10) AS block
      FROM s GROUP BY pair_id, func, first_ord)
SELECT pair_id, string_agg(block, '' ORDER BY first_ord, func) AS summary FROM f GROUP BY pair_id"""


# ------------------------------------------------------------------ functions

def diff_expressions_sql() -> str:
    """Differing pairs of a function in the order of a parallel walk, a flag each; a pair's place is the number of flags before it."""
    quoted = lambda c: f"chr(39) || {c} || chr(39)"
    flags = ["f1", "f2", "greatest(f3, f4)", "f4", "f5", "greatest(f1, f2)", "f1", "f2"]
    place = lambda k: "CAST(" + (" + ".join(flags[:k]) or "0") + " AS BIGINT)"
    args = lambda side, which: (f"'x;' || {side}_i" if which == 2 else f"{quoted(side + '_k')} || ';' || {side}_p")
    records = [  # (pair, fires, seq, rule, type, old, new)
        (0, "f1 = 1", "0", "R15", "string_change", "o_s", "n_s"), (1, "f2 = 1", "0", "R16", "fstring_change", "o_f", "n_f"),
        (2, "f3 = 1", "0", "R18", "function_call_change", "o_g", "n_g"), (2, "f4 = 1", "f3", "R19", "function_arguments_change", args("o", 2), args("n", 2)),
        (4, "f5 = 1", "0", "R34", "attribute_assignment_change", "o_v", "n_v"),
        (5, "f1 + f2 > 0", "0", "R19", "function_arguments_change", args("o", 5), args("n", 5)), (6, "f1 = 1", "0", "R15", "string_change", "o_k", "n_k"),
        (7, "f2 = 1", "0", "R34", "attribute_assignment_change", "o_p", "n_p")]
    return f"WITH e AS ({V.expression_sides_sql()})" + " UNION ALL ".join(
        f"""
SELECT CAST(l_orderkey AS VARCHAR) AS pair_id, 'fn_' || CAST(place AS VARCHAR) AS func, {place(k)} AS pos, CAST({seq} AS BIGINT) AS seq, '{rule}' AS rule,
  '{type_}' AS type, {old} AS old, {new} AS new FROM e WHERE {fires}""" for k, fires, seq, rule, type_, old, new in records)


def functions_last_wins_sql() -> str:
    return f"""WITH fv AS ({V.functions_sql()})
SELECT pair_id, CAST(version AS BIGINT) AS version, func, arg_max(body, walk_ord) AS body,
  CAST(max(walk_ord) AS BIGINT) AS walk_ord, CAST(min(walk_ord) AS BIGINT) AS first_ord
FROM fv GROUP BY pair_id, version, func"""


def functions_join_sql() -> str:
    return f"""WITH fv AS ({V.functions_sql()}),
o AS (SELECT pair_id, func, min(walk_ord) AS first_ord, max(walk_ord) AS old_walk, arg_max(body, walk_ord) AS old_body
      FROM fv WHERE version = 0 GROUP BY pair_id, func),
n AS (SELECT pair_id, func, max(walk_ord) AS new_walk, arg_max(body, walk_ord) AS new_body
      FROM fv WHERE version = 1 GROUP BY pair_id, func)
SELECT o.pair_id, o.func, CAST(first_ord AS BIGINT) AS first_ord, CAST(old_walk AS BIGINT) AS old_walk,
  CAST(new_walk AS BIGINT) AS new_walk, old_body, new_body
FROM o JOIN n ON o.pair_id = n.pair_id AND o.func = n.func"""


def extract_functions_sql() -> str:
    """Expected parser output for the generated sources: top-level definitions in file
    order, then nested helpers in the order of their parents (breadth-first)."""
    return f"""WITH sb AS ({V.source_blocks_sql()}),
files AS (SELECT l_orderkey, bool_or(s_ret = 'return x +') AS broken, count(*) AS n_top FROM sb GROUP BY l_orderkey),
top AS (
  SELECT CAST(sb.l_orderkey AS VARCHAR) AS pair_id, fname AS func, CAST(pos AS BIGINT) AS walk_ord, fargs AS args,
    CAST(CASE WHEN nested THEN 4 ELSE 3 END AS BIGINT) AS n_stmts,
    CASE WHEN nested THEN 'Assign,FunctionDef,If,Return' ELSE 'Assign,If,Return' END AS kinds,
    s_assign || '|' || CASE WHEN nested THEN gdef || chr(10) || '    ' || gret || '|' ELSE '' END
      || s_if || '|' || s_ret AS texts,
    CAST(NULL AS VARCHAR) AS error_kind
  FROM sb JOIN files f ON f.l_orderkey = sb.l_orderkey WHERE NOT f.broken),
inner_defs AS (
  SELECT CAST(sb.l_orderkey AS VARCHAR) AS pair_id, regexp_extract(gdef, 'def (g_[0-9]+)', 1) AS func,
    CAST(f.n_top + row_number() OVER (PARTITION BY sb.l_orderkey ORDER BY pos) - 1 AS BIGINT) AS walk_ord,
    'y' AS args, CAST(1 AS BIGINT) AS n_stmts, 'Return' AS kinds, gret AS texts, CAST(NULL AS VARCHAR) AS error_kind
  FROM sb JOIN files f ON f.l_orderkey = sb.l_orderkey WHERE NOT f.broken AND nested),
bad AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS pair_id, CAST(NULL AS VARCHAR) AS func, CAST(NULL AS BIGINT) AS walk_ord,
    CAST(NULL AS VARCHAR) AS args, CAST(NULL AS BIGINT) AS n_stmts, CAST(NULL AS VARCHAR) AS kinds,
    CAST(NULL AS VARCHAR) AS texts, 'SyntaxError' AS error_kind
  FROM files WHERE broken)
SELECT * FROM top UNION ALL SELECT * FROM inner_defs UNION ALL SELECT * FROM bad"""


def extract_odd_sql() -> str:
    """Of the method the one positional parameter that is not positional-only, canonical texts; the plain function inside the
    ``async def``, breadth-first after it."""
    no_error = "CAST(NULL AS VARCHAR) AS error_kind"
    return f"""
SELECT CAST(p_partkey AS VARCHAR) AS pair_id, 'm_' || CAST(p_partkey % 5 AS VARCHAR) AS func, CAST(0 AS BIGINT) AS walk_ord, 'q' AS args, CAST(2 AS BIGINT) AS n_stmts,
  'Assign,Return' AS kinds, 'x = q + ' || CAST(p_size AS VARCHAR) || '|return x' AS texts, {no_error} FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'inner', CAST(1 AS BIGINT), 'z', CAST(1 AS BIGINT), 'Return', 'return [z, ' || CAST(p_size AS VARCHAR) || ']', {no_error} FROM part"""


# ------------------------------------------------------------------ text pairs

def _doc_lines() -> str:
    return f"""dp AS ({V.doc_pairs_sql()}),
ol AS (SELECT pair_id, unnest(string_split(old_text, chr(10))) AS line,
         unnest(range(len(string_split(old_text, chr(10))))) AS pos FROM dp),
nl AS (SELECT pair_id, unnest(string_split(new_text, chr(10))) AS line,
         unnest(range(len(string_split(new_text, chr(10))))) AS pos FROM dp)"""


def align_positions_sql() -> str:
    return f"""WITH {_doc_lines()}
SELECT coalesce(ol.pair_id, nl.pair_id) AS pair_id, CAST(coalesce(ol.pos, nl.pos) AS BIGINT) AS pos,
  ol.line AS old_line, nl.line AS new_line
FROM ol FULL OUTER JOIN nl ON ol.pair_id = nl.pair_id AND ol.pos = nl.pos"""


def added_tail_sql() -> str:
    return f"""WITH {_doc_lines()},
olen AS (SELECT pair_id, count(*) AS n FROM ol GROUP BY pair_id)
SELECT nl.pair_id, CAST(nl.pos AS BIGINT) AS pos, 'R36' AS rule, 'condition_added' AS type, nl.line AS cond,
  nl.line AS body, 'doc' AS function
FROM nl JOIN olen ON olen.pair_id = nl.pair_id
WHERE nl.pos >= olen.n AND contains(nl.line, ',')"""


def reordered_sql() -> str:
    return f"""WITH {_doc_lines()},
o AS (SELECT pair_id, line, min(pos) AS op FROM ol GROUP BY pair_id, line),
n AS (SELECT pair_id, line, min(pos) AS np FROM nl GROUP BY pair_id, line),
m AS (SELECT o.pair_id, o.line AS statement, op, np FROM o JOIN n ON o.pair_id = n.pair_id AND o.line = n.line
      WHERE op <> np)
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY op) - 1 AS BIGINT) AS seq, statement,
  CAST(op AS BIGINT) AS old_position, CAST(np AS BIGINT) AS new_position
FROM m"""


# ------------------------------------------------------------------ scoring

def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


def score_lexical_sql(raw_sql: str | None = None, error: str = "NULL") -> str:
    raw_sql = raw_sql or V.text_pairs_sql()
    norm = lambda x: f"lower({_strip(x)})"
    parts = []
    for side, col in (("a", "summary"), ("b", "explanation")):
        w, t = f"w_{col}", f"t_{col}"
        parts.append(f"SELECT pair_id, 'word_tf' AS model, '{side}' AS side, unnest({w}) AS term FROM tp")
        parts.append(f"SELECT pair_id, 'word_bigram_tf' AS model, '{side}' AS side, "
                     f"unnest(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])) AS term FROM tp")
        parts.append(f"SELECT pair_id, 'char3_tf' AS model, '{side}' AS side, "
                     f"unnest(list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3))) AS term FROM tp")
    union = "\n  UNION ALL ".join(parts)
    base = " UNION ALL ".join(f"SELECT pair_id, '{m}' AS model FROM tp" for m in ("word_tf", "word_bigram_tf", "char3_tf"))
    return f"""WITH raw AS ({raw_sql}),
known AS (SELECT pair_id AS known_id, {error} AS known FROM raw),
nt AS (SELECT pair_id, {norm('summary')} AS t_summary, {norm('explanation')} AS t_explanation FROM raw),
tp AS (SELECT pair_id, t_summary, t_explanation, {_words('t_summary')} AS w_summary,
         {_words('t_explanation')} AS w_explanation FROM nt),
t AS ({union}),
tf AS (SELECT pair_id, model, term, CAST(count(*) FILTER (WHERE side = 'a') AS DOUBLE) AS a,
         CAST(count(*) FILTER (WHERE side = 'b') AS DOUBLE) AS b FROM t GROUP BY pair_id, model, term),
agg AS (SELECT pair_id, model, sum(a * b) AS dot, sum(a * a) AS na, sum(b * b) AS nb FROM tf GROUP BY pair_id, model),
base AS ({base}),
sc AS (SELECT base.pair_id, base.model,
         CASE WHEN na > 0 AND nb > 0 THEN dot / (sqrt(na) * sqrt(nb)) END AS score
       FROM base LEFT JOIN agg ON agg.pair_id = base.pair_id AND agg.model = base.model)
SELECT pair_id, model, round(score, 4) AS score, printf('%.2f', score) AS shown, coalesce(score >= 0.6, false) AS is_match,
  CASE WHEN score IS NULL THEN coalesce(CAST(known AS VARCHAR), 'empty_text') END AS error
FROM sc JOIN known ON known_id = pair_id"""


def _dense(models) -> str:
    parts = []
    for name, start, width in models:
        a = f"list_slice(left_vec, {start}, {start + width - 1})"
        b = f"list_slice(right_vec, {start}, {start + width - 1})"
        parts.append(f"SELECT pair_id, '{name}' AS model, list_cosine_similarity("
                     f"CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS score FROM vp")
    union = " UNION ALL ".join(parts)
    return f"""WITH vp AS ({V.vector_pairs_sql()}), sc AS ({union})
SELECT pair_id, model, round(score, 4) AS score, printf('%.2f', score) AS shown, coalesce(score >= 0.6, false) AS is_match,
  CASE WHEN score IS NULL THEN 'missing_vector' END AS error
FROM sc"""


# ------------------------------------------------------------------ replies / text

def _clean(x: str) -> str:
    s1 = _strip(f"regexp_replace({x}, '(?m)^```(?:python)?', '', 'g')")
    s2 = _strip(f"regexp_replace({s1}, '(?m)```$', '', 'g')")
    return _strip(f"regexp_replace({s2}, '(?i)\\AFixed Code:{WS}*', '')")


def reply_parse_sql() -> str:
    d = "'---EXPLANATION---'"
    return f"""WITH r AS ({V.replies_sql()}),
p AS (SELECT pair_id, reply, strpos(reply, {d}) AS dpos FROM r)
SELECT pair_id,
  CASE WHEN reply = 'NO BUGS FOUND' THEN 'no_bug' WHEN dpos > 0 THEN 'ok' ELSE 'no_delimiter' END AS status,
  CASE WHEN reply = 'NO BUGS FOUND' THEN '' WHEN dpos > 0 THEN {_clean('substr(reply, 1, dpos - 1)')} END AS fixed,
  CASE WHEN reply <> 'NO BUGS FOUND' AND dpos > 0 THEN substr(reply, dpos + 17) END AS explanation
FROM p"""


def reply_clean_sql() -> str:
    return f"WITH r AS ({V.replies_sql()}) SELECT pair_id, {_clean('reply')} AS cleaned FROM r"


def versions_union_sql() -> str:
    return f"""WITH p AS ({reply_parse_sql()}), r AS ({V.replies_sql()})
SELECT pair_id, CAST(0 AS BIGINT) AS version, source FROM r
UNION ALL SELECT pair_id, CAST(1 AS BIGINT) AS version, fixed AS source FROM p WHERE fixed IS NOT NULL"""


def request_text_sql() -> str:
    head = ("chr(10) || '    You are a senior software engineer.' || chr(10) || '    The following code has a bug.' "
            "|| chr(10) || '    1. Provide only the fixed code without extra explanation.' || chr(10) || "
            "'    2. Provide a detailed explanation of what was changed (after the fixed code, separated by a "
            "delimiter ''---EXPLANATION---'').' || chr(10) || '    3. If no bugs were found, the explanaton "
            "should be \"NO BUGS FOUND\".' || chr(10) || chr(10) || '    Code:' || chr(10) || '    '")
    return f"SELECT doc_id, {head} || text || chr(10) || '    ' AS request FROM documents"


def text_normalise_sql() -> str:
    return f"SELECT conv_id, turn, lower({_strip('text')}) AS norm FROM conversations"


# ------------------------------------------------------------------ items

def manifest_expand_sql() -> str:
    return f"""WITH pr AS ({V.projects_sql()})
SELECT project, CAST(unnest(range(1, n_bugs + 1)) AS BIGINT) AS bug_id FROM pr WHERE n_bugs >= 1"""


def manifest_versions_sql() -> str:
    return f"""WITH b AS ({manifest_expand_sql()}),
v AS (SELECT project, bug_id, 0 AS version, 'buggy' AS label FROM b
      UNION ALL SELECT project, bug_id, 1 AS version, 'fixed' AS label FROM b)
SELECT project, bug_id, CAST(version AS BIGINT) AS version, label,
  'all_bugs/' || project || '/' || CAST(bug_id AS VARCHAR) || '/' || label AS path
FROM v"""


def corpus_keys_sql() -> str:
    pat = r"^(.*?)/?([^/]+)/([0-9]+)/(buggy|fixed)/(.+)$"
    return f"""WITH fl AS ({V.files_sql()} UNION ALL SELECT url AS path, html AS source FROM pages),
p AS (SELECT path, replace(path, chr(92), '/') AS p FROM fl)
SELECT path, regexp_extract(p, '{pat}', 2) AS project, CAST(regexp_extract(p, '{pat}', 3) AS BIGINT) AS bug_id,
  regexp_extract(p, '{pat}', 4) AS label, regexp_extract(p, '{pat}', 5) AS rel_path
FROM p WHERE regexp_matches(p, '{pat}')"""


def _patch_rel(header: str) -> str:
    toks = f"string_split_regex({_strip(header)}, '{WS}+')"
    hit = f"list_filter({toks}, lambda t: starts_with(t, 'b/'))[1]"
    return (f"CASE WHEN starts_with({header}, 'diff') AND length(substr({hit}, 3)) > 0 "
            f"THEN replace(substr({hit}, 3), chr(92), '/') END")


def patch_path_sql() -> str:
    return f"""WITH p AS ({V.patches_sql()})
SELECT project, CAST(bug_id AS BIGINT) AS bug_id, {_patch_rel("regexp_split_to_array(patch, '\\r\\n|\\r|\\n')[1]")} AS rel_path
FROM p"""


def item_status_sql() -> str:
    return f"""WITH it AS ({V.items_sql()}), pp AS ({patch_path_sql()}),
hd AS (SELECT project, bug_id, min(regexp_split_to_array(patch, '\\r\\n|\\r|\\n')[1]) AS header FROM ({V.patches_sql()}) x GROUP BY project, bug_id), fl AS (SELECT DISTINCT path FROM ({V.files_sql()}) x),
j AS (SELECT it.project, it.bug_id, pp.bug_id IS NOT NULL AS has_patch, pp.rel_path, hd.header,
        CASE WHEN pp.rel_path IS NOT NULL THEN it.project || '/' || CAST(it.bug_id AS VARCHAR) || '/buggy/' || it.project
          || '/' || pp.rel_path END AS buggy_path
      FROM it LEFT JOIN pp ON pp.project = it.project AND pp.bug_id = it.bug_id
      LEFT JOIN hd ON hd.project = it.project AND hd.bug_id = it.bug_id)
SELECT j.project, CAST(j.bug_id AS BIGINT) AS bug_id, rel_path, buggy_path,
  CASE WHEN NOT has_patch THEN 'patch_missing' WHEN rel_path IS NULL THEN 'no_path'
       WHEN fl.path IS NULL THEN 'file_missing' ELSE 'ok' END AS status,
  CASE WHEN NOT has_patch THEN 'patch_missing: ' || j.project || '/' || CAST(j.bug_id AS VARCHAR)
       WHEN rel_path IS NULL THEN 'no_path: ' || header
       WHEN fl.path IS NULL THEN 'file_missing: ' || buggy_path END AS error
FROM j LEFT JOIN fl ON fl.path = j.buggy_path"""


def status_counts_sql() -> str:
    return f"""WITH s AS ({item_status_sql()})
SELECT project, status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY project, status"""


def _tree_sql() -> str:
    """CTE ``tr``: the items of the generated tree, what their diffs name and what the checkout holds."""
    rel = "replace(substr(list_filter(string_split(header, ' '), lambda t: starts_with(t, 'b/'))[1], 3), chr(92), '/')"
    return f"""fl AS (SELECT * FROM ({V.tree_files_sql('duckdb')}) x),
it AS (SELECT DISTINCT split_part(path, '/', 1) AS project, CAST(split_part(path, '/', 2) AS BIGINT) AS bug_id FROM fl WHERE split_part(path, '/', 2) <> 'notes'),
pt AS (SELECT project, bug_id, string_split(patch, chr(10))[1] AS header FROM ({V.tree_patches_sql('duckdb')}) x),
nm AS (SELECT it.project, it.bug_id, header, CASE WHEN starts_with(header, 'diff') THEN nullif({rel}, '') END AS rel_path
       FROM it LEFT JOIN pt ON pt.project = it.project AND pt.bug_id = it.bug_id),
np AS (SELECT *, CASE WHEN rel_path IS NOT NULL THEN project || '/' || CAST(bug_id AS VARCHAR) || '/buggy/' || project || '/' || rel_path END AS buggy_path FROM nm),
tr AS (SELECT np.*, fl.text AS source,
         CASE WHEN header IS NULL THEN 'patch_missing' WHEN rel_path IS NULL THEN 'no_path' WHEN fl.path IS NULL THEN 'file_missing' ELSE 'ok' END AS status,
         CASE WHEN header IS NULL THEN 'patch_missing: ' || np.project || '/' || CAST(np.bug_id AS VARCHAR)
              WHEN rel_path IS NULL THEN 'no_path: ' || header WHEN fl.path IS NULL THEN 'file_missing: ' || buggy_path END AS error
       FROM np LEFT JOIN fl ON fl.path = np.buggy_path)"""


def tree_items_sql() -> str:
    return f"WITH {_tree_sql()} SELECT project, bug_id, rel_path, buggy_path, status, error, md5(source) AS source_md5 FROM tr"


def tree_outcomes_sql() -> str:
    """Every function of an item changes one value, if the item's file is Python and its reply usable code."""
    q, g = "''", "(tr.bug_id - 1) // 3"
    block = (f"'Function: page_' || CAST(page_id AS VARCHAR) || chr(10) || '- Value of variable {q}y{q} changed from {q}x + ' || CAST(page_id AS VARCHAR) || '{q} to {q}x + '"
             f" || CAST(page_id + 1 AS VARCHAR) || '{q}.' || chr(10) || '- Change of type {q}assignment_value_change{q} detected.' || chr(10) || chr(10)")
    return f"""WITH {_tree_sql()},
rp AS (SELECT * FROM ({V.tree_replies_sql('duckdb')}) x),
fn AS (SELECT page_id - page_id % {V.TREE_PAGES} AS g, string_agg({block}, '' ORDER BY page_id) AS full_summary, count(*) AS n FROM pages GROUP BY ALL),
st AS (SELECT tr.project || '/' || CAST(tr.bug_id AS VARCHAR) AS pair_id,
  CASE WHEN tr.status <> 'ok' THEN tr.status WHEN rp.reply IS NULL THEN 'reply_missing' WHEN {g} % 7 = 1 THEN 'no_delimiter'
       WHEN {g} % 3 = 0 OR {g} % 7 = 2 THEN 'parse_error' WHEN {g} % 7 = 0 THEN 'no_bug' ELSE 'ok' END AS status,
  tr.error, full_summary, n
  FROM tr JOIN fn ON fn.g = {g} LEFT JOIN rp ON rp.project = tr.project AND rp.bug_id = tr.bug_id)
SELECT pair_id, status, CAST(CASE WHEN status = 'ok' THEN n ELSE 0 END AS BIGINT) AS n_functions,
  CAST(CASE WHEN status = 'ok' THEN 2 * n ELSE 0 END AS BIGINT) AS n_changes, CASE WHEN status = 'ok' THEN full_summary ELSE '' END AS summary,
  CASE WHEN status = 'parse_error' THEN 'SyntaxError' WHEN status = 'reply_missing' THEN 'reply_missing: ' || pair_id ELSE error END AS error
FROM st"""


def end_to_end_sql() -> str:
    """Expected chain on the generated corpus: for orders with k % 3 = 0 every top-level
    definition's assignment gains ``+ 1`` (R06, R21); for k % 3 = 1 its final return
    subtracts (R17, R30); for the other even ones its condition admits equality (R02, R22);
    k % 7 = 5 replies are the sentinel; files holding a broken return do not parse and have no
    score. Functions repeat names: the last definition wins, the first keeps its place.
    Summaries are then scored like ``score_lexical``."""
    q = "''"
    nl = "chr(10)"
    other = lambda t: f" || '- Change of type {q}{t}{q} detected.' || {nl}"
    value_lines = (f"'- Value of variable {q}x{q} changed from {q}' || qv || '{q} to {q}' || qv || ' + 1{q}.' || {nl}"
                   + other("assignment_value_change"))
    return_lines = "''" + other("return_change") + other("return_value_change")
    if_lines = f"'- Condition changed from {q}x > ' || dv || '{q} to {q}x >= ' || dv || '{q}.' || {nl}" + other("if_condition_change")
    raw = f"""WITH sb AS ({V.source_blocks_sql()}),
files AS (SELECT l_orderkey, bool_or(s_ret = 'return x +') AS broken FROM sb GROUP BY l_orderkey),
fn AS (SELECT l_orderkey, fname, min(pos) AS first_ord, arg_max(substr(s_assign, 5), pos) AS qv,
         arg_max(regexp_extract(s_if, 'x > ([0-9]+)', 1), pos) AS dv
       FROM sb GROUP BY l_orderkey, fname),
summ AS (
  SELECT fn.l_orderkey,
    string_agg('Function: ' || fname || {nl}
      || CASE WHEN fn.l_orderkey % 3 = 0 THEN {value_lines} WHEN fn.l_orderkey % 3 = 1 THEN {return_lines}
         ELSE {if_lines} END || {nl}, '' ORDER BY first_ord) AS summary
  FROM fn JOIN files ON files.l_orderkey = fn.l_orderkey
  WHERE NOT files.broken AND (fn.l_orderkey % 3 IN (0, 1) OR fn.l_orderkey % 2 = 0) AND fn.l_orderkey % 7 <> 5
  GROUP BY fn.l_orderkey)
SELECT CAST(files.l_orderkey AS VARCHAR) AS pair_id, files.broken,
  CASE WHEN files.broken THEN '' ELSE coalesce(summ.summary, '') END AS summary,
  CASE WHEN files.broken OR files.l_orderkey % 7 = 5 THEN '' ELSE {nl} || {V.explanation_sql("files.l_orderkey")} END AS explanation
FROM files LEFT JOIN summ ON summ.l_orderkey = files.l_orderkey"""
    return score_lexical_sql(f"SELECT * FROM ({raw}) e2e", "CASE WHEN broken THEN 'SyntaxError' END")


ORACLE = {
    "manifest_expand": manifest_expand_sql(),
    "manifest_versions": manifest_versions_sql(),
    "corpus_keys": corpus_keys_sql(),
    "patch_path": patch_path_sql(),
    "item_status": item_status_sql(),
    "tree_items": tree_items_sql(),
    "tree_outcomes": tree_outcomes_sql(),
    "status_counts": status_counts_sql(),
    "versions_union": versions_union_sql(),
    "request_text": request_text_sql(),
    "reply_parse": reply_parse_sql(),
    "reply_clean": reply_clean_sql(),
    "text_normalise": text_normalise_sql(),
    "extract_functions": extract_functions_sql(),
    "extract_odd_functions": extract_odd_sql(),
    "functions_last_wins": functions_last_wins_sql(),
    "functions_join": functions_join_sql(),
    "align_positions": align_positions_sql(),
    "added_tail": added_tail_sql(),
    "reordered": reordered_sql(),
    **{f"diff_{fam}": diff_sql(fam) for fam in ("conditions", "loops", "assign", "functions", "imports", "exceptions",
                                                "classes", "literals", "returns", "calls", "docstrings", "attributes")},
    "changes_json": changes_json_sql(),
    "changes_roundtrip": changes_roundtrip_sql(),
    "render_sentences": render_sentences_sql(),
    "summary_text": summary_text_sql(),
    "summary_from_json": summary_text_sql(),
    "diff_strict": diff_strict_sql(),
    "diff_expressions": diff_expressions_sql(),
    "render_all_types": render_all_types_sql(),
    "score_pairs": score_pairs_sql(),
    "score_stored_pairs": score_pairs_sql(),
    "encode_hashed": encode_hashed_sql(),
    "score_hashed_idf": score_hashed_idf_sql(),
    "score_lexical": score_lexical_sql(),
    "score_dense": _dense((("dense", 1, 64),)),
    "score_models": _dense(V.VECTOR_MODELS),
    "end_to_end": end_to_end_sql(),
}
