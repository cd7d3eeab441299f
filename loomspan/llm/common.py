"""Small helpers shared by the operators: table access, row keys, Arrow maps, the train/held-out split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and _key, a 64-bit name of both: rows share a key only if they are equal in both columns."""
    return docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.lit(1), F.col("text")).alias("_key"))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text divides by 5; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS != 0, F.lit(False))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 2048) -> DataFrame:
    """mapInArrow with a function from batch to batch; at most so many rows at once bound a worker's memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                out = step(batch.slice(begin, rows))
                if out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks
    return df.mapInArrow(run, schema)


def binary_rows(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string or binary column, row by row."""
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return (v.as_py() for v in values)
