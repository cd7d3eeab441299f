"""Chronological splits, walk-forward folds and cross-sectional labels."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import SplitConfig
from loomspan.operators.ordering import positions
from loomspan.operators.ranking import WINDOW_BOUND, rank_pct


def date_split(df: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """(Date, Split): train / val / test cut on the distinct dates, sizes truncated to whole dates."""
    days = df.agg(F.sort_array(F.collect_set("Date")).alias("d"))
    n = F.col("n")
    n_train = F.floor(n * F.lit(cfg.train))
    n_val = F.floor(n * F.lit(cfg.val))
    return (
        days.select(F.size("d").alias("n"), F.posexplode("d").alias("i", "Date"))
        .select("Date", F.when(F.col("i") < n_train, "train").when(F.col("i") < n_train + n_val, "val")
                .otherwise("test").alias("Split"))
    )


def with_split(df: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """The date table has one row per session, so it is broadcast."""
    return df.join(F.broadcast(date_split(df, cfg)), "Date")


def split_summary(split_df: DataFrame) -> DataFrame:
    return split_df.groupBy("Split").agg(
        F.count("*").alias("rows"), F.countDistinct("Date").alias("sessions"),
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


def splits_overlap(split_df: DataFrame) -> DataFrame:
    """Dates that occur in more than one split (must be empty)."""
    return split_df.groupBy("Date").agg(F.countDistinct("Split").alias("splits")).where("splits > 1")


def global_position(df: DataFrame, group_bound: int | None = None) -> DataFrame:
    """0-based position `Pos` in (Date, Ticker) order and the total `Total`, without one global sort.

    With a proven bound on the rows per date, per-date counts give the offset of each date (a table of
    one row per session) and a row_number orders the rows inside a date. Without a bound the rows are range
    partitioned, which also splits a date that holds a large share of all rows.
    """
    if group_bound is None or group_bound > WINDOW_BOUND:
        return positions(df, ["Date", "Ticker"])
    days = df.groupBy("Date").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(F.lit(1)).orderBy("Date")
    offsets = days.select(
        "Date",
        F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("Total"),
    )
    inside = Window.partitionBy("Date").orderBy("Ticker")
    return df.join(F.broadcast(offsets), "Date").withColumn(
        "Pos", F.col("_off") + F.row_number().over(inside) - 1).drop("_off")


def walk_forward_folds(df: DataFrame, n_splits: int = 5, max_rows: int | None = None,
                       group_bound: int | None = None) -> DataFrame:
    """One row per (Fold, row) a row belongs to, with Role train or validate; expanding train window.

    k = max(2, min(n_splits, max(2, n // 400))) folds of max(500, n // (k + 2)) rows at the end of the
    sample; with max_rows only the tail of the sample is used. Folds cut rows, so a date may be split.
    """
    placed = global_position(df, group_bound)
    total = F.col("Total")
    used = F.least(total, F.lit(max_rows)) if max_rows else total
    n = used.cast("long")
    at = F.col("Pos") - (total - n)
    k = F.greatest(F.lit(2), F.least(F.lit(n_splits), F.greatest(F.lit(2), F.floor(n / 400))))
    kept = placed.withColumns({"_n": n, "_at": at}).where("_at >= 0").withColumn("_k", k.cast("int"))
    test = F.greatest(F.lit(500), F.floor(F.col("_n") / (F.col("_k") + 2)))
    folds = kept.withColumn("_test", test).withColumn("Fold", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    start = F.col("_n") - (F.col("_k") - F.col("Fold")) * F.col("_test")
    short = F.raise_error(F.lit("too few rows for the requested number of folds"))
    role = F.when(start <= 0, short).when(F.col("_at") < start, "train").when(F.col("_at") < start + F.col("_test"), "validate")
    return folds.withColumn("Role", role).where(F.col("Role").isNotNull()).drop(
        "_n", "_at", "_k", "_test", "Pos", "Total")


def feasible_folds(rows: int, wanted: int = 5) -> int:
    """Most folds up to `wanted` that walk_forward_folds can place over so many rows: each takes 500 rows or more and the first needs rows before it."""
    for k in range(wanted, 1, -1):
        used = max(2, min(k, max(2, rows // 400)))
        if used * max(500, rows // (used + 2)) < rows:
            return k
    raise ValueError(f"{rows} rows are too few for two folds")


def parameter_grid(spec: dict[str, list]) -> list[dict]:
    """All combinations of a parameter spec, in the order of its keys."""
    return [dict(zip(spec, values)) for values in product(*spec.values())]


def daily_demean(df: DataFrame, group_bound: int | None = None) -> DataFrame:
    """Relative_Target (label minus the day mean) and Rank_Target (percentile rank in the day - 0.5).

    The day mean is an aggregate joined back as a per-session table, not a window over the day.
    """
    means = df.groupBy("Date").agg(F.avg("Target").alias("_mean"))
    out = df.join(F.broadcast(means), "Date").withColumn("Relative_Target", F.col("Target") - F.col("_mean"))
    ranked = rank_pct(out.drop("_mean"), ["Date"], "Target", "_rank", group_bound)
    return ranked.withColumn("Rank_Target", F.col("_rank") - 0.5).drop("_rank")
