"""Positions and predecessors in a global row order without one global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomspan.session import materialise

SHIFT = 33  # monotonically_increasing_id holds the partition number above these bits


def ordered_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with _part and _at: range-partitioned by the unique keys, sorted and numbered inside each part.

    The parts are balanced by Spark's sampling whatever the skew of the leading key. The numbered rows are
    written once to the shared folder, because a second evaluation could cut the ranges differently.
    """
    numbered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    kept = materialise(numbered, "ordered")
    return kept.withColumns({
        "_part": F.shiftright("_id", SHIFT), "_at": F.col("_id").bitwiseAND((1 << SHIFT) - 1)}).drop("_id")


def _parts() -> WindowSpec:
    """Order of the table of parts (one row per task)."""
    return Window.partitionBy(F.lit(1)).orderBy("_part")


def positions(df: DataFrame, keys: list[str], out: str = "Pos", total: str = "Total") -> DataFrame:
    """0-based position of every row in the order of the unique keys, and the number of rows."""
    rows = ordered_rows(df, keys)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_c"))
    before = _parts().rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                           F.sum("_c").over(Window.partitionBy(F.lit(1))).alias(total))
    return rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_off") + F.col("_at")).drop("_part", "_at", "_off")


def previous(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Value of the preceding row in the order of the unique keys; NULL for the first row."""
    rows = ordered_rows(df, keys)
    ends = rows.groupBy("_part").agg(F.max_by(value, "_at").alias("_end"))
    carried = ends.select("_part", F.lag("_end").over(_parts()).alias("_carry"))
    inside = F.lag(value).over(Window.partitionBy("_part").orderBy("_at"))
    return (
        rows.withColumn("_in", inside).join(F.broadcast(carried), "_part")
        .withColumn(out, F.when(F.col("_at") == 0, F.col("_carry")).otherwise(F.col("_in")))
        .drop("_part", "_at", "_in", "_carry")
    )
