"""Sinks: Parquet marts, small CSV/JSON reports and the pruned serving copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERVING_COLUMNS = ("Date", "Ticker", "Return_1d", "AdjClose", "Vol_21d", "VIX_Level")


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite through Spark's commit protocol; date-partitioned marts allow partition pruning."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_yearly(df: DataFrame, path: str) -> None:
    write_parquet(df.withColumn("year", F.year("Date")), path, ("year",))


def write_csv(df: DataFrame, path: str) -> None:
    """Report tables (one row per model, asset or strategy). Written in parallel, header in each file."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_serving_copy(features: DataFrame, path: str) -> None:
    missing = [c for c in SERVING_COLUMNS if c not in features.columns]
    if missing:
        raise KeyError(f"feature table lacks serving columns {missing}")
    features.select(*SERVING_COLUMNS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def report_rows(accounting: DataFrame, key: str) -> DataFrame:
    """Per-key accounting rows as (key, JSON document) rows."""
    others = sorted(c for c in accounting.columns if c != key)
    return accounting.select(F.col(key), F.to_json(F.struct(*others)).alias("report"))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """present / rows / columns per named table; the row counts are one distributed aggregate each."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("artifact"), F.lit(True).alias("present"), "rows",
            F.lit(len(df.columns)).cast("long").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out
