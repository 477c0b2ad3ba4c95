"""Change records -> sentences -> per-item summary text; K1 JSON form.

Sentences are one ``CASE`` on ``type``. Per-item text (summary and JSON) is built per
function first, then per item from one small string per function, sorted by the
function's first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import apart
from .rules import ALL_RULES

# ---- fixed values: sentence templates (must equal the reference's wording)
TPL_VAR_RENAME = "Variable '%s' was renamed to '%s'."
TPL_VAR_VALUE = "Value of variable '%s' changed from '%s' to '%s'."
TPL_CONDITION_CHANGE = "Condition changed from '%s' to '%s'."
TPL_CONDITION_ADDED = "A new condition '%s' was added in function '%s'."
TPL_REORDERED = "Statement '%s' moved from line %s to %s in function '%s'."
TPL_FUNCTION_ADDED = "Function '%s' was added."
TPL_OTHER = "Change of type '%s' detected."
BLOCK_HEADER = "Function: "
LINE_PREFIX = "- "
# ---- end of fixed values


def _py(c: Column) -> Column:
    """How a Python f-string shows a possibly-missing string value."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def sentence(type_: Column | None = None) -> Column:
    """N1-N7 over CHANGE_PAYLOAD columns in scope."""
    c = F.col
    type_ = c("type") if type_ is None else type_
    return (F.when(apart(type_) == "var_rename", F.format_string(TPL_VAR_RENAME, _py(c("old")), _py(c("new"))))
            .when(type_ == "var_value_change",
                  F.format_string(TPL_VAR_VALUE, _py(c("target")), _py(c("old")), _py(c("new"))))
            .when(type_ == "condition_change", F.format_string(TPL_CONDITION_CHANGE, _py(c("old")), _py(c("new"))))
            .when(type_ == "condition_added",
                  F.format_string(TPL_CONDITION_ADDED, _py(c("condition")), _py(c("function"))))
            .when(type_ == "statement_reordered",
                  F.format_string(TPL_REORDERED, _py(c("statement")), _py(c("old_position")),
                                  _py(c("new_position")), _py(c("function"))))
            .when(type_ == "function_added", F.format_string(TPL_FUNCTION_ADDED, _py(c("function"))))
            .otherwise(F.format_string(TPL_OTHER, _py(type_))))


def render_changes(changes: DataFrame) -> DataFrame:
    """Adds ``sentence`` to every change row."""
    return changes.withColumn("sentence", sentence())


def change_json() -> Column:
    """K1: one JSON object per record, keys in the reference's order, nulls kept."""
    opts = {"ignoreNullFields": "false"}
    out = None
    for r in ALL_RULES:
        fields = [F.col("type").alias("type")]
        for k in r.keys:
            if k.endswith("[]"):
                name = k[:-2]
                fields.append(F.col(f"{name}_list" if name in ("old", "new") else name).alias(name))
            else:
                fields.append(F.col(k).alias(k))
        js = F.to_json(F.struct(*fields), opts)
        out = F.when(F.col("rule") == r.rule, js) if out is None else out.when(F.col("rule") == r.rule, js)
    return out


def item_texts(changes: DataFrame, key: str = "pair_id", order=("phase", "pos", "seq"), carry=()) -> DataFrame:
    """Per item: ``summary`` (N8 blocks) and ``changes_json`` (K1 map func -> list).

    Records become their sentence and JSON text, are shuffled once on the item key, folded per
    function and then per item in ``first_ord`` order; both folds run on that one partitioning.
    Records keep ``order`` inside a function. Rows without a rule add no record but keep their
    item, with an empty summary, and give it the ``carry`` columns.
    """
    texts = changes.select(key, "func", "first_ord", *carry, F.when(F.col("rule").isNotNull(), F.struct(
        *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], sentence().alias("s"), change_json().alias("j"))).alias("rec"))
    per_func = (texts.repartition(key).groupBy(key, "func", "first_ord")
                .agg(F.array_sort(F.collect_list("rec")).alias("rs"), *[F.max(c).alias(c) for c in carry]))
    rs = F.col("rs")
    key_json = F.regexp_replace(F.regexp_replace(F.to_json(F.array(F.col("func"))), r"^\[", ""), r"\]$", "")
    block = F.concat(F.lit(BLOCK_HEADER), F.col("func"), F.lit("\n"),
                     F.array_join(F.transform(rs, lambda r: F.concat(F.lit(LINE_PREFIX), r["s"], F.lit("\n"))), ""),
                     F.lit("\n"))
    frag = F.concat(key_json, F.lit(":["), F.array_join(F.transform(rs, lambda r: r["j"]), ","), F.lit("]"))
    blocks = per_func.select(key, *carry, F.when(F.size(rs) > 0, F.struct(
        F.col("first_ord").alias("f0"), F.col("func").alias("f1"), block.alias("b"), frag.alias("j"), F.size(rs).alias("n"))).alias("blk"))
    g = blocks.groupBy(key).agg(F.array_sort(F.collect_list("blk")).alias("bs"), *[F.max(c).alias(c) for c in carry])
    bs = F.col("bs")
    return g.select(key, *carry,
                    F.array_join(F.transform(bs, lambda b: b["b"]), "").alias("summary"),
                    F.concat(F.lit("{"), F.array_join(F.transform(bs, lambda b: b["j"]), ","), F.lit("}"))
                    .alias("changes_json"),
                    F.size(bs).alias("n_functions"),
                    F.aggregate(bs, F.lit(0), lambda acc, b: acc + b["n"]).alias("n_changes"))


def summarize(changes: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, summary)."""
    return item_texts(changes, key).select(key, "summary")
