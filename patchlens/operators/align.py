"""E5/A1 last-wins, J3 name join, J4-J7 positional alignment, R36 tail, R37 reorder.

Items that hold both versions are paired and aligned inside the parse stage (``extract.extract_pairs``).
For function rows that come as a table, ``pair_functions`` does the same by ``(pair_id, func)``: the last
definition of a name wins, the first keeps its place; who wins is settled on numbers before any body moves. Everything
after it is per-row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CHANGE_PAYLOAD, PHASE_REORDER
from .rules import ALL_RULES, EXTENDED, NO_RULE, REORDER_RULE, candidate, candidates, change_struct, payload_columns, with_firing

OLD, NEW = 0, 1


def last_wins(functions: DataFrame, keys=("pair_id", "version", "func"), order: str = "walk_ord") -> DataFrame:
    """One row per key: payload of the greatest ``order``, plus ``first_ord`` = smallest.

    Late materialisation: the winner of a name is found from its orders alone, in a hash aggregation of
    numbers; payloads are then fetched by a join on the key that streams them past the winners, so they are
    shuffled once and neither sorted nor aggregated (Spark's runtime filter cuts off rows without a winner where the table is large). Orders are unique
    within a key, as the parse stage makes them.
    """
    keys = list(keys)
    payload = [c for c in functions.columns if c not in keys and c not in (order, "error")]
    live = functions.where(F.col("func").isNotNull()) if "func" in keys else functions
    won = live.groupBy(*keys).agg(F.max(order).alias("_won"), F.min(order).alias("first_ord"))
    return _fetched(live, won, keys, F.col(order) >= F.col("_won")).select(*keys, *payload, order, "first_ord")


def _fetched(rows: DataFrame, winners: DataFrame, keys: list[str], chosen) -> DataFrame:
    """``rows`` that win, with their winner's columns. ``chosen`` is no equality, so both sides are dealt by ``keys`` alone and the
    winners stay where they were aggregated; they are the side that is hashed, the rows pass by."""
    w = winners.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in winners.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(w.hint("shuffle_hash"), [*same, chosen], "inner").drop(*[f"_k_{k}" for k in keys])


def pair_functions(functions: DataFrame, payload: str = "stmts", order: str = "walk_ord") -> DataFrame:
    """Last-wins per version and the inner join of old and new by name.

    In: (pair_id, version, func, walk_ord, <payload>, ...). Out: (pair_id, func, first_ord,
    old_walk, new_walk, old_<payload>, new_<payload>) for names present in both versions;
    ``first_ord`` is the first place of the name in the old file. Winners and matches are found from orders
    alone, as in ``last_wins``; each version's winning payloads are then fetched, and joined on the same partitioning.
    """
    v, w = F.col("version"), F.col(order)
    old_w, new_w = F.when(v == OLD, w), F.when(v == NEW, w)
    named = functions.where(F.col("func").isNotNull())
    won = named.groupBy("pair_id", "func").agg(
        F.min(old_w).alias("first_ord"), F.max(old_w).alias("old_walk"), F.max(new_w).alias("new_walk"))
    won = won.where(F.col("old_walk").isNotNull() & F.col("new_walk").isNotNull())
    keys = ["pair_id", "func"]

    def side(version: int, walk: str, out: str, *more: str) -> DataFrame:
        rows = named.where(v == version).select(*keys, w.alias("_at"), F.col(payload).alias(out))
        return _fetched(rows, won.select(*keys, walk, *more), keys, F.col("_at") >= F.col(walk)).drop("_at")

    old = side(OLD, "old_walk", f"old_{payload}", "first_ord")
    new = side(NEW, "new_walk", f"new_{payload}").select(*[F.col(k).alias(f"_n_{k}") for k in keys], "new_walk", f"new_{payload}")
    both = old.join(new, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys], "inner")
    return both.select("pair_id", "func", "first_ord", "old_walk", "new_walk", f"old_{payload}", f"new_{payload}")


def align_functions(pairs: DataFrame, old: str = "old_stmts", new: str = "new_stmts") -> DataFrame:
    """Statement slots ``pos`` with null padding on the shorter side."""
    keys = [c for c in pairs.columns if c not in (old, new)]
    z = F.arrays_zip(F.col(old).alias("o"), F.col(new).alias("n"))
    return (pairs.select(*keys, F.posexplode(z).alias("pos", "_z"))
            .select(*keys, "pos", F.col("_z.o").alias("old"), F.col("_z.n").alias("new")))


def with_moved(df: DataFrame, old: str = "old_stmts", new: str = "new_stmts", out: str = "_moved") -> DataFrame:
    """Adds ``out`` = statement texts present on both sides whose FIRST positions
    differ, as (statement, old_position, new_position), in old-body order.

    O(n log n) per function and no per-element scans: both sides' texts are tagged
    (text, side, index) and sorted together; the head of every (text, side) run holds the
    first index; an old head directly followed by a new head of the same text is a shared
    statement. Each step reads a column materialised by the step before it.
    """
    tag = lambda arr, side: F.transform(F.col(arr), lambda s, i: F.struct(
        s["text"].alias("t"), F.lit(side).alias("side"), i.alias("i")))
    keys = df.columns
    rs = F.col("_rs")
    step1 = df.select(*keys, F.sort_array(F.concat(tag(old, 0), tag(new, 1))).alias("_rs"))

    def head(e, k):
        prev = rs[k - 1]
        return F.when(k == 0, e).otherwise(F.when((prev["t"] != e["t"]) | (prev["side"] != e["side"]), e))

    step2 = step1.select(*keys, F.filter(F.transform(rs, head), lambda e: e.isNotNull()).alias("_hs"))
    hs = F.col("_hs")

    def pair(e, j):
        nxt = hs[j + 1]
        hit = (e["side"] == 0) & (nxt["side"] == 1) & (nxt["t"] == e["t"]) & (nxt["i"] != e["i"])
        return F.when(j + 1 < F.size(hs), F.when(hit, F.struct(
            e["i"].cast("int").alias("old_position"), e["t"].alias("statement"),
            nxt["i"].cast("int").alias("new_position"))))

    moved = F.sort_array(F.filter(F.transform(hs, pair), lambda m: m.isNotNull()))
    step3 = step2.select(*keys, F.transform(moved, lambda m: F.struct(
        m["statement"].alias("statement"), m["old_position"].alias("old_position"),
        m["new_position"].alias("new_position"))).alias(out))
    return step3


def diff_reordered(pairs: DataFrame, old: str = "old_stmts", new: str = "new_stmts", func: str = "func") -> DataFrame:
    """R37 rows alone: (keys..., seq, CHANGE_PAYLOAD)."""
    keys = [c for c in pairs.columns if c not in (old, new)]
    rec = lambda m: change_struct(REORDER_RULE.rule, REORDER_RULE.type, statement=m["statement"],
                                  old_position=m["old_position"], new_position=m["new_position"],
                                  function=F.col(func))
    staged = with_moved(pairs, old, new)
    out = staged.select(*keys, F.posexplode(F.transform(F.col("_moved"), rec)).alias("seq", "c"))
    return out.select(*keys, "seq", *[F.col("c")[f].alias(f) for f in CHANGE_PAYLOAD.fieldNames()])


def diff_tail(slots: DataFrame) -> DataFrame:
    """R36 rows alone from aligned slots (old null, new an ``if``)."""
    from .rules import diff_nodes
    return diff_nodes(slots.where(F.col("old").isNull() & F.col("new").isNotNull()))


def function_changes(slots: DataFrame, mode: str = "reference", func: str = "func", keep_items: bool = False) -> DataFrame:
    """All change rows of matched functions in one pass over the SLOT rows of ``extract_pairs``, which has aligned their statements.

    Out: keys of ``slots`` + (phase, pos, seq) + CHANGE_PAYLOAD. Records of a function
    sort by (phase, pos, seq): aligned slots and the added tail in position order, then
    reordered statements in old-body order. With ``keep_items`` the rows without a function
    name stay, as rows without a rule. In mode ``extended`` the rules of the reference also read pairs of expressions;
    those records come between, ``pos`` being the pair's place in the function.
    """
    own = ("phase", "pos", "old", "new", "statement", "old_position", "new_position")
    keys = [c for c in slots.columns if c not in own]
    mode = "reference" if mode == EXTENDED else mode
    fn, at = F.col(func), ("phase", "pos")
    moved = ("statement", "old_position", "new_position")
    staged = with_firing(slots.select(*keys, *at, *moved, F.col("old").alias("_o"), F.col("new").alias("_n")), mode)
    recs = [*candidates(mode), candidate(F.col("phase") == PHASE_REORDER, F.lit(ALL_RULES.index(REORDER_RULE)))]
    if keep_items:
        recs.append(candidate(fn.isNull(), F.lit(NO_RULE)))
    out = staged.select(*keys, *at, *moved, "_o", "_n", F.explode(F.array(*recs)).alias("_c")).where(F.col("_c").isNotNull())
    return out.select(*keys, *at, *payload_columns(fn, mode, reordered={**{f: F.col(f) for f in moved}, "function": fn}))
