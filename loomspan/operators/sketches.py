"""Mergeable statistics of returns: one row of moments and a quantile sketch per series and month.

A new day touches the rows of its month alone: write() replaces the partitions it is given and leaves the others. What spans months is merged from
the rows, so a question over any range of months reads a row per series and month instead of the returns.

A quantile from a sketch of size k has, with 99 % confidence, a rank within rank_error(k) of the one asked for (the published bound of the
KLL sketch); below about k values it is exact. Moments are exact up to rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 2000


def rank_error(k: int = SIZE) -> float:
    """Two-sided rank error of a quantile at 99 % confidence, as a share of the values."""
    return 2.296 / k ** 0.9021


def by_month(returns: DataFrame, k: int = SIZE) -> DataFrame:
    """(Ticker, Month, n, mean, m2, low, high, sketch) of the returns (Date, Ticker, r) that are not null."""
    rows = returns.where(F.col("r").isNotNull()).withColumn("Month", F.trunc("Date", "month"))
    n = F.count("r")
    return rows.groupBy("Ticker", "Month").agg(
        n.alias("n"), F.avg("r").alias("mean"), (F.var_pop("r") * n).alias("m2"), F.min("r").alias("low"), F.max("r").alias("high"),
        F.kll_sketch_agg_double(F.col("r").cast("double"), F.lit(k)).alias("sketch"))


def write(months: DataFrame, path: str) -> None:
    """Rows of by_month for some months take the place of these months' partitions; all others stay.

    Rows of a month go to few tasks, as many as its size asks for, so files follow the data and not tasks times months.
    """
    months.hint("rebalance", "Month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Month").parquet(path)


def merged(months: DataFrame) -> DataFrame:
    """(Ticker, n, mean, variance, low, high, sketch) of every series over the months given: a row per month meets in a task, a few hundred."""
    part = F.struct("n", "mean", "m2")
    whole = months.groupBy("Ticker").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(part).alias("_parts"),  # a row per month
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))
    # squared deviations inside the months, and of the months' means around the mean of the whole
    m2 = F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x["m2"] + x["n"] * F.pow(x["mean"] - F.col("mean"), 2.0))
    return whole.select("Ticker", "n", "mean", (m2 / F.col("n")).alias("variance"), "low", "high", "sketch")


def quantile(p: float | Column) -> Column:
    """The p-quantile of a merged sketch."""
    return F.kll_sketch_get_quantile_double("sketch", p if isinstance(p, Column) else F.lit(p))


def tail_mean(p: float, points: int = 50) -> Column:
    """Mean of the values up to the p-quantile, from so many quantiles inside the tail."""
    inside = [quantile(p * (i + 0.5) / points) for i in range(points)]
    return sum(inside[1:], inside[0]) / points
