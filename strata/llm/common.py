"""Shared helpers: tables, words, schemas, Arrow batching by bytes; and the written intermediates of the library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.storage import discard, shared_dir, written

__all__ = ["SPACE", "WORD", "all_columns", "byte_slices", "discard", "schema_with", "shared_dir", "small_batches", "table", "word_count", "written"]

#: ASCII white space that separates words, as a Java character class and as SQL text.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_columns(df: DataFrame) -> list[Column]:
    """Every column of ``df``, whatever its name holds."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch in this session, so that a worker's memory does not follow the rows' sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def schema_with(df: DataFrame, **more: T.DataType) -> T.StructType:
    """The schema of ``df`` with further nullable columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def byte_slices(batch: pa.RecordBatch, column: str | pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices whose ``column``, its own or one as long, holds about ``limit`` bytes at most (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column) if isinstance(column, str) else column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
