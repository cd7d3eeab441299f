"""Integrity checks as DataFrame operators: each returns the offending rows or a small verdict table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.expr import corr, finite


def _compare(whole: DataFrame, part: DataFrame, cutoff: Column, columns: list[str], rtol: float, atol: float) -> DataFrame:
    """Per column: rows at or before the cutoff and how many differ between the two builds."""
    left = whole.where(F.col("Date") <= cutoff).select("Date", "Ticker", *columns)
    right = part.where(F.col("Date") <= cutoff).select(
        "Date", "Ticker", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    both = left.withColumn("_here", F.lit(True)).join(right, ["Date", "Ticker"], "full")

    def differs(c: str) -> Column:
        a, b = F.col(c).cast("double"), F.col(f"_{c}").cast("double")
        far = F.abs(a - b) > atol + rtol * F.abs(b)
        return F.col("_here").isNull() | F.col("_there").isNull() | (a.isNull() != b.isNull()) | F.coalesce(far, F.lit(False))

    found = both.agg(F.count("*").alias("rows"), *[F.count_if(differs(c)).alias(c) for c in columns])
    return found.unpivot("rows", columns, "Column", "Mismatches")


def truncation_probe(panel: DataFrame, build: Callable[[DataFrame], DataFrame], cutoff: Column, columns: list[str],
                     rtol: float = 1e-7, atol: float = 1e-10) -> DataFrame:
    """Build on all rows and on rows up to the cutoff; a trailing feature must not change."""
    return _compare(build(panel), build(panel.where(F.col("Date") <= cutoff)), cutoff, columns, rtol, atol)


def corruption_probe(panel: DataFrame, build: Callable[[DataFrame], DataFrame], cutoff: Column, columns: list[str],
                     fields: list[str], rtol: float = 1e-7, atol: float = 1e-10) -> DataFrame:
    """Replace every field after the cutoff by hash noise; earlier features must not change."""
    noise = F.abs(F.xxhash64("Date", "Ticker") % 1000) / 10.0 + 1.0
    spoiled = panel.withColumns({c: F.when(F.col("Date") > cutoff, noise).otherwise(F.col(c)) for c in fields})
    return _compare(build(panel), build(spoiled), cutoff, columns, rtol, atol)


def label_leak_guard(features: DataFrame, columns: list[str], label: str = "Target", limit: float = 0.99,
                     min_pairs: int = 200) -> DataFrame:
    """(Column, Corr, Leaks) of every feature against the label, in one pass."""
    got = features.agg(F.array(*[
        F.struct(F.lit(c).alias("Column"), corr(F.col(c).cast("double"), F.col(label)).alias("Corr"),
                 F.count(F.col(c).cast("double") + F.col(label)).alias("Pairs")) for c in columns]).alias("x"))
    return got.select(F.explode("x").alias("x")).select("x.*").withColumn(
        "Leaks", F.coalesce((F.col("Pairs") >= min_pairs) & (F.abs("Corr") > limit), F.lit(False)))


def whole_sample_norm_guard(features: DataFrame, columns: list[str], min_rows: int = 100) -> DataFrame:
    """Columns that look standardised over the whole sample: mean of about 0 and deviation of about 1."""
    got = features.agg(F.array(*[
        F.struct(F.lit(c).alias("Column"), F.avg(c).alias("Mean"), F.stddev_samp(c).alias("Std"), F.count(c).alias("N"))
        for c in columns]).alias("x"))
    return got.select(F.explode("x").alias("x")).select("x.*").withColumn(
        "Normalised", F.coalesce((F.col("N") >= min_rows) & (F.abs("Mean") < 1e-6)
                                 & (F.col("Std") > 0.9) & (F.col("Std") < 1.1), F.lit(False)))


def constant_column_guard(features: DataFrame, columns: list[str]) -> DataFrame:
    """(Column, Constant): fewer than two distinct values, found by min and max instead of a distinct count."""
    got = features.agg(F.array(*[
        F.struct(F.lit(c).alias("Column"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("Constant"))
        for c in columns]).alias("x"))
    return got.select(F.explode("x").alias("x")).select("x.*")


def finite_guard(features: DataFrame, columns: list[str]) -> DataFrame:
    """(Column, Bad): NULL, NaN or infinite cells."""
    got = features.agg(*[F.count_if(finite(F.col(c).cast("double")).isNull()).alias(c) for c in columns])
    return got.unpivot([], columns, "Column", "Bad")


def duplicate_keys(panel: DataFrame) -> DataFrame:
    return panel.groupBy("Date", "Ticker").agg(F.count("*").alias("Copies")).where("Copies > 1")


def calendar_consistency(panel: DataFrame) -> DataFrame:
    """One row: fewest and most sessions of a series, fewest and most series of a date."""
    s = panel.groupBy("Ticker").agg(F.count("*").alias("c")).agg(F.min("c").alias("min_sessions"), F.max("c").alias("max_sessions"))
    d = panel.groupBy("Date").agg(F.count("*").alias("c")).agg(F.min("c").alias("min_series"), F.max("c").alias("max_series"))
    out = s.withColumns({c: d.select(c).scalar() for c in d.columns})
    return out.withColumn("consistent", (F.col("min_sessions") == F.col("max_sessions")) & (F.col("min_series") == F.col("max_series")))


def simplex_guard(weights: DataFrame, column: str = "w", cap: float = 1.0, tol: float = 1e-6) -> DataFrame:
    return weights.agg(
        F.sum(column).alias("total"), F.min(column).alias("lowest"), F.max(column).alias("highest")
    ).withColumn("valid", (F.abs(F.col("total") - 1) <= tol) & (F.col("lowest") >= -tol) & (F.col("highest") <= cap + tol))


def key_difference(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Keys missing from and surplus in `present`."""
    missing = expected.subtract(present).withColumn("Side", F.lit("missing"))
    extra = present.subtract(expected).withColumn("Side", F.lit("extra"))
    return missing.unionByName(extra)


def key_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)
