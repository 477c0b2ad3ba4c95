"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.session import ensure_checkpoint_dir

#: Rows of one Arrow batch: very long texts stay within a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: later reads survive lost executors. The cluster clears the folder, or
    Spark does with ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``fn`` from a batch's columns (lists by name) to the output columns, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def with_text_columns(df: DataFrame, text: str, fn: Callable[[list], dict[str, list]], schema: str) -> DataFrame:
    """``df``, all its columns untouched, and the columns that ``fn`` makes of a batch's texts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    more = StructType.fromDDL(schema)
    if clash := {f.name for f in more} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    new = to_arrow_schema(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[f.name], f.type) for f in new)],
                                             schema=pa.schema([*batch.schema, *new]))

    return df.mapInArrow(run, StructType([*df.schema, *more]))


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of a value's decimal text modulo ``modulus``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
