"""Change sets and summaries to storage and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.rules import ALL_RULES
from ..schemas import CHANGE_PAYLOAD, ITEM_STATUSES, STATUS_NO_BUG, STATUS_OK
from .tree import write_files

_TEXT_FIELDS = ("type", "function", "target", "class", "module", "old", "new", "condition", "statement")
CHANGES_JSON_SCHEMA = ("map<string, array<struct<" + ", ".join(f"`{f}`: string" for f in _TEXT_FIELDS)
                       + ", body: array<string>, old_position: int, new_position: int>>>")
# a stored record names its type; rules of one type share their keys, so the first stands for all
_RULE_OF_TYPE = {r.type: r.rule for r in reversed(ALL_RULES)}
_LIST_TYPES = sorted({r.type for r in ALL_RULES if "old[]" in r.keys})


def _writer(df: DataFrame, partition_by: str | None, mode: str):
    """A writer that, told a partition column, replaces only the partitions that ``df`` has rows of: running one project
    again leaves the files of the others as they are, and running it twice gives what running it once gives."""
    w = df.write.mode(mode)
    return w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic") if partition_by else w


def write_changes(changes: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """K1 typed form: change rows as parquet (optionally partitioned, e.g. by project)."""
    _writer(changes, partition_by, mode).parquet(path)


def write_changes_json(texts: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """K1 JSON form: one JSON line per item, ``{"pair_id": ..., "changes": {func: [records]}}``
    (the nested change set is embedded as parsed JSON, not as a quoted string)."""
    key_json = F.regexp_extract(F.to_json(F.struct(F.col("pair_id").alias("k"))), r'^\{"k":(.*)\}$', 1)
    line = F.concat(F.lit('{"pair_id":'), key_json,
                    F.lit(',"changes":'), F.col("changes_json"), F.lit("}"))
    rows = texts.select(line.alias("value"), *([partition_by] if partition_by else []))
    _writer(rows, partition_by, mode).option("compression", "gzip").text(path)


def read_changes(df: DataFrame, col: str = "changes_json", key: str = "pair_id") -> DataFrame:
    """Nested JSON text -> change rows as the renderer takes them: (key, func, first_ord,
    phase, pos, seq) in stored order and the CHANGE_PAYLOAD columns, lists as lists and
    positions as numbers. An unknown type keeps its record with a null rule."""
    m = F.from_json(F.col(col), CHANGES_JSON_SCHEMA)
    funcs = df.select(key, F.posexplode(F.map_entries(m)).alias("first_ord", "_e"))
    recs = funcs.select(key, F.col("_e.key").alias("func"), "first_ord", F.posexplode(F.col("_e.value")).alias("pos", "r"))
    r, is_list = F.col("r"), F.col("r.type").isin(*_LIST_TYPES)
    rule = F.create_map(*[F.lit(x) for pair in sorted(_RULE_OF_TYPE.items()) for x in pair])[r["type"]]
    as_list = lambda f: F.when(is_list, F.from_json(r[f], "array<string>"))
    made = {"rule": rule, "old": F.when(~is_list, r["old"]), "new": F.when(~is_list, r["new"]),
            "old_list": as_list("old"), "new_list": as_list("new")}
    return recs.select(key, "func", "first_ord", F.lit(0).alias("phase"), "pos", F.lit(0).alias("seq"),
                       *[(made[f.name] if f.name in made else r[f.name]).cast(f.dataType).alias(f.name)
                         for f in CHANGE_PAYLOAD.fields])


def write_summaries(texts: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """K2: summary text per item (parquet; the text column is the reference's file body)."""
    _writer(texts.select("pair_id", "summary", *([partition_by] if partition_by else [])), partition_by, mode).parquet(path)


def write_summary_files(texts: DataFrame, root: str, key: str = "pair_id", suffix: str = ".txt") -> int:
    """K2 as files: each item's summary in a file of its own below ``root``, named by its key, in a folder for each ``/`` of it. A file that
    already holds the summary is left alone. Returns the number of items."""
    name = F.concat(F.col(key).cast("string"), F.lit(suffix))
    return write_files(texts.where(F.col(key).isNotNull()).select(name.alias("path"), F.col("summary").alias("text")), root)


def write_versions(versions: DataFrame, root: str, key: str = "pair_id") -> int:
    """K3 as files: the two versions of each item, ``<key>/code1.py`` and ``<key>/code2.py``. Returns the number of files."""
    name = F.concat(F.col(key).cast("string"), F.lit("/code"), (F.col("version") + 1).cast("string"), F.lit(".py"))
    return write_files(versions.where(F.col(key).isNotNull()).select(name.alias("path"), F.col("source").alias("text")), root)


def write_outcomes(items: DataFrame, path: str, status: str = "status") -> dict[str, int]:
    """Items to ``<path>/quarantined=false`` and, those whose outcome is a failure, beside them to ``quarantined=true``. Returns the number of items
    of each outcome, counted while they are written: the items are computed once."""
    seen = Observation("outcomes")
    counted = items.observe(seen, *[F.count_if(F.col(status) == s).alias(s) for s in ITEM_STATUSES])
    failed = ~F.col(status).isin(STATUS_OK, STATUS_NO_BUG)
    counted.withColumn("quarantined", failed).write.mode("overwrite").partitionBy("quarantined").parquet(path)
    return {s: n for s, n in seen.get.items() if n}
