"""A checkout tree as a data source, and the files its items need.

Layout (folder names as in the tree): ``<root>/<project>/<bug>/buggy/<project>/<path>`` holds the checkouts and
``<patches>/<project>/bugs/<bug>/bug_patch.txt`` the diffs. ``PatchItems`` is a Spark data source whose rows
are the items, one for each bug folder, with the first line of its diff. Only folders of the two upper levels are
listed, on the driver, as a file index would; conditions on ``project`` and ``bug_id`` are taken from the query and cut folders
off before they are listed or planned. The folders are dealt into partitions; a task opens one diff for each of its items and reads
no further than its first line.

``read_sources`` then opens exactly the files that items resolve to, where they lie: a checkout holds thousands of
files, of which one is wanted, so no checkout is ever listed. All paths go through ``pyarrow.fs``: plain paths
and the stores it knows by URI.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual)

from ..functions.text import first_line
from ..schemas import STATUS_FILE_MISSING, STATUS_NO_PATH, STATUS_OK, STATUS_PATCH_MISSING
from .items import patch_path

# ---- fixed values: names within the tree
PATCH_FOLDER, PATCH_FILE, BUGGY = "bugs", "bug_patch.txt", "buggy"
# ---- end of fixed values

#: Items of one partition unless the option ``items_a_partition`` says otherwise.
ITEMS_A_PARTITION = 256
#: Bytes read at a time while looking for the end of a diff's first line.
_HEAD_BYTES = 4096
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or a plain absolute path."""
    if "://" in uri or uri.startswith("file:"):
        store, path = fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and "://" not in uri else uri)
        return store, path.rstrip("/")
    return fs.LocalFileSystem(), uri.rstrip("/")


def _folders(store: fs.FileSystem, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it is not there."""
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def first_line_of(store: fs.FileSystem, path: str) -> str | None:
    """The first line of a text file without its end, or None if there is no such file. No more than its block is read."""
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_file(path) as file:
        head = b""
        while b"\n" not in head and (more := file.read(_HEAD_BYTES)):
            head += more
    return head.split(b"\n", 1)[0].decode("utf-8", "replace")


@dataclass
class ItemGroup(InputPartition):
    """Items of one task: (project, bug folder)."""

    items: list[tuple[str, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.patches = options["root"], options["patches"]
        self.size = int(options.get("items_a_partition", ITEMS_A_PARTITION))
        self.conditions: list[Filter] = []

    def holds(self, column: str, value) -> bool:
        """Whether the conditions on one column allow the value."""
        for f in self.conditions:
            if f.attribute != (column,):
                continue
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
                return False
            if isinstance(f, GreaterThan) and not value > f.value or isinstance(f, GreaterThanOrEqual) and not value >= f.value:
                return False
            if isinstance(f, LessThan) and not value < f.value or isinstance(f, LessThanOrEqual) and not value <= f.value:
                return False
        return True

    def partitions(self) -> list[ItemGroup]:
        store, root = store_of(self.root)
        items = [(p, b) for p in _folders(store, root) if self.holds("project", p)
                 for b in _folders(store, f"{root}/{p}") if b.isascii() and b.isdigit() and self.holds("bug_id", int(b))]
        return [ItemGroup(items[k:k + self.size]) for k in range(0, len(items), self.size)] or [ItemGroup([])]

    def read(self, partition: ItemGroup) -> Iterator[tuple]:
        store, patches = store_of(self.patches)
        for project, bug in partition.items:
            header = first_line_of(store, f"{patches}/{project}/{PATCH_FOLDER}/{bug}/{PATCH_FILE}")
            yield project, int(bug), bug, header


class _PushingReader(_Reader):
    """Takes the conditions on the two key columns; whatever else there is stays with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("project",), ("bug_id",)):
                self.conditions.append(f)
            elif not (isinstance(f, IsNotNull) and f.attribute in (("project",), ("bug_id",))):  # keys are never null
                yield f


class PatchItems(DataSource):
    """Options: ``root``, ``patches`` and, if wanted, ``items_a_partition`` and ``pushdown`` (true where the session lets Python data
    sources take conditions)."""

    @classmethod
    def name(cls) -> str:
        return "patch_items"

    def schema(self) -> str:
        return "project string, bug_id long, folder string, header string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options))


def scan_items(spark: SparkSession, root: str, patches: str, items_a_partition: int = ITEMS_A_PARTITION) -> DataFrame:
    """(project, bug_id, folder, header) of every item of a checkout tree; ``header`` is null without a diff."""
    spark.dataSource.register(PatchItems)
    return (spark.read.format("patch_items").option("root", root).option("patches", patches)
            .option("items_a_partition", str(items_a_partition)).option("pushdown", str(spark.conf.get(_PUSHDOWN, "false")).lower()).load())


def read_sources(items: DataFrame, root: str, path: str = "buggy_path", opened=None) -> DataFrame:
    """``items`` and the ``source`` text of the file each names below ``root``: null without a path or a file. Only these files are
    opened, in the tasks that hold the rows; ``opened``, an accumulator, counts them. A path that leads out of ``root`` names no
    file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*items.schema, StructField("source", StringType())])
    arrow = to_arrow_schema(schema)
    at = items.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root)

        def text(name: str | None) -> str | None:
            if name is None or ".." in name.split("/") or store.get_file_info(f"{top}/{name}").type != fs.FileType.File:
                return None
            if opened is not None:
                opened.add(1)
            with store.open_input_file(f"{top}/{name}") as file:
                return file.read().decode("utf-8", "replace")

        for batch in batches:
            for k in range(0, batch.num_rows, 16):  # whole files: few rows at a time
                part = batch.slice(k, 16)
                texts = [text(name) for name in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=arrow)

    return items.mapInArrow(run, schema)


def named_items(spark: SparkSession, root: str, patches: str, items_a_partition: int = ITEMS_A_PARTITION) -> DataFrame:
    """(project, bug_id, header, rel_path, buggy_path) of every item of a tree: the file that its diff's first line names,
    ``buggy_path`` below ``root``. No checkout is looked into."""
    items = scan_items(spark, root, patches, items_a_partition)
    head = first_line(F.col("header"))
    rel = F.when(head.isNotNull(), patch_path(head))
    return items.select("project", "bug_id", head.alias("header"), "folder", rel.alias("rel_path")).withColumn("buggy_path", F.when(
        F.col("rel_path").isNotNull(), F.concat_ws("/", "project", "folder", F.lit(BUGGY), "project", "rel_path"))).drop("folder")


def with_outcome(found: DataFrame) -> DataFrame:
    """Named items with their ``source``, and (status, error): the first failing check names the outcome, ``error`` what was looked at."""
    status = (F.when(F.col("header").isNull(), F.lit(STATUS_PATCH_MISSING)).when(F.col("rel_path").isNull(), F.lit(STATUS_NO_PATH))
              .when(F.col("source").isNull(), F.lit(STATUS_FILE_MISSING)).otherwise(F.lit(STATUS_OK)))
    seen = F.coalesce("buggy_path", "header", F.concat_ws("/", "project", F.col("bug_id").cast("string")))
    return (found.withColumn("status", status)
            .withColumn("error", F.when(F.col("status") != STATUS_OK, F.concat(F.col("status"), F.lit(": "), seen))).drop("header"))


def resolve_tree(spark: SparkSession, root: str, patches: str, items_a_partition: int = ITEMS_A_PARTITION, opened=None) -> DataFrame:
    """(project, bug_id, rel_path, buggy_path, source, status, error) of every item of a tree, in one narrow plan: patch
    missing, no path, file missing or ok."""
    return with_outcome(read_sources(named_items(spark, root, patches, items_a_partition), root, opened=opened))


def write_files(files: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Each row's text as a file of its own below ``root``; a file that is there with the same content is left alone. Returns the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ".." in name.split("/"):
                    raise ValueError(f"{name} leads out of the folder")
                target, data = f"{top}/{name}", (body or "").encode()
                info = store.get_file_info(target)
                if info.type == fs.FileType.File and info.size == len(data):
                    with store.open_input_file(target) as old:
                        if old.read() == data:
                            continue
                store.create_dir(target.rpartition("/")[0], recursive=True)
                # written beside its place and moved there: a task that is run again never leaves half a file
                with store.open_output_stream(target + ".part") as out:
                    out.write(data)
                store.move(target + ".part", target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select(path, text).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
