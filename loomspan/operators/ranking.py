"""Exact ranks and quantiles that do not depend on a group fitting into one task.

A plain rank window sorts a whole group in one task. That is right when the group has a proven bound
(a configured universe, the days of a calendar) and wrong when one group may hold a third of
all rows. For unbounded groups the size of the largest is measured first. Up to RANGE_ROWS a window per group is
right; beyond, the values are collapsed to (group, value, count), each group is cut into value ranges at sketched
quantiles, and only (group, range) is ever sorted; a small prefix table over the ranges makes the result exact however
rough the cut points are. Quantiles need no ranks: sketched values around each one leave few rows to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import materialise


WINDOW_BOUND = 1_000_000
RANGES = 64  # parts that one round of cutting makes of a group or range
RANGE_ROWS = 200_000  # distinct values in a sorted range, about
SKETCH = 2000  # accuracy of sketched quantiles: ranks are off by one in so many rows at most


def counted_ranks(df: DataFrame, by: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """(by, value, _c, _before, _n): copies of each value, rows below it and rows in the group."""
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    )
    counts = materialise(counts, "counts")  # read three times below
    largest = counts.groupBy(*by).agg(F.count("*").alias("_d")).agg(F.max("_d")).first()[0] or 0
    group = Window.partitionBy(*[F.col(b) for b in by]) if by else Window.partitionBy(F.lit(1))
    if largest <= RANGE_ROWS:
        below = F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        return counts.select(*by, value, "_c", F.coalesce(below, F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("_n"))
    probs = [i / ranges for i in range(1, ranges)]
    placed, made = counts.withColumn("_range", F.lit(0).cast("long")), 1
    while made == 1 or made * RANGE_ROWS < largest:  # each round cuts every range again, so ranges follow the data
        cuts = placed.groupBy(*by, "_range").agg(F.percentile_approx(value, probs, 1000).alias("_cuts"))
        placed = placed.join(cuts, [*by, "_range"]) if made > 1 else _attach(placed, cuts.drop("_range"), by)
        placed = placed.withColumn(
            "_range", F.col("_range") * ranges + F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
        made *= ranges
    per_range = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_rc"))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = per_range.select(
        *by, "_range",
        F.coalesce(F.sum("_rc").over(before), F.lit(0)).alias("_base"),
        F.sum("_rc").over(group).alias("_n"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(base, [*by, "_range"])
        .withColumn("_before", F.col("_base") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
        .select(*by, value, "_c", "_before", "_n")
    )


def _attach(df: DataFrame, one_per_group: DataFrame, by: list[str]) -> DataFrame:
    """Equi-join with a table of one row per group; the planner broadcasts it when its size allows."""
    if by:
        return df.join(one_per_group, by)
    one = one_per_group.columns
    return df.withColumns({c: one_per_group.select(c).scalar() for c in one})


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group: a bound for whatever keeps or drops rows of `df`."""
    return df.groupBy(*by).agg(F.count("*").alias("_d")).agg(F.max("_d")).first()[0] or 0


def rank_pct(df: DataFrame, by: list[str], value: str, out: str, group_bound: int | None = None,
             ranges: int = RANGES) -> DataFrame:
    """Percentile rank with average ties over the non-null values of each group, NULL for NULL.

    Without a bound the rows are written once and the largest group is counted, NULL rows included. Up to RANGE_ROWS it is one
    window; beyond, the rows are read for the counts and for the join back, and NULL rows stay out of both.

    `group_bound` is the proven maximum of rows per group (e.g. the size of a configured universe);
    with it the rank is one window without a look at the rows.
    """
    if group_bound is not None and group_bound <= WINDOW_BOUND:
        return df.withColumn(out, rank_pct_window(F.col(value), by))
    rows = materialise(df, "ranked")
    if largest_group(rows, by) <= RANGE_ROWS:
        return rows.withColumn(out, rank_pct_window(F.col(value), by))
    ranked = counted_ranks(rows, by, value, ranges).select(
        *by, value, ((F.col("_before") + (F.col("_c") + 1) / 2.0) / F.col("_n")).alias(out))
    known = rows.where(F.col(value).isNotNull()).join(ranked, [*by, value], "left")
    return known.unionByName(rows.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def rank_pct_window(value: Column, by: list) -> Column:
    """Average rank = mean of the first rank of a tie and the number of values up to it: one ordered window."""
    group = Window.partitionBy(*by)
    ordered = group.orderBy(value.asc_nulls_last())
    upto = F.count(value).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(ordered) + upto) / 2.0 / F.count(value).over(group))


def normalise_window(value: Column, by: list | None = None) -> Column:
    """normalise as one expression, for groups with a proven bound; no `by` means one group."""
    keys = by or [F.lit(1)]
    group = Window.partitionBy(*keys)
    flat = F.coalesce(F.min(value).over(group) == F.max(value).over(group), F.lit(True))
    return F.when(flat, 0.5).otherwise(rank_pct_window(value, keys))


def normalise(df: DataFrame, by: list[str], value: str, out: str, group_bound: int | None = None) -> DataFrame:
    """rank_pct, but 0.5 for the whole group when it has at most one distinct value."""
    if group_bound is not None and group_bound <= WINDOW_BOUND:
        return df.withColumn(out, normalise_window(F.col(value), by))
    spread = df.groupBy(*by).agg((F.coalesce(F.min(value) == F.max(value), F.lit(True))).alias("_flat"))
    ranked = rank_pct(df, by, value, "_rank")
    return _attach(ranked, spread, by).withColumn(
        out, F.when(F.col("_flat"), 0.5).otherwise(F.col("_rank"))).drop("_rank", "_flat")


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
              group_bound: int | None = None, ranges: int = RANGES) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of `probs`.

    Without a bound the values are written once. A sketch gives two values around each quantile, a pass counts the rows below the
    first, and only those between both, a few in a thousand, are ranked. A small group is kept whole. Should a sketch miss, which
    shows as a quantile without a value, all rows are ranked.
    """
    if group_bound is not None and group_bound <= WINDOW_BOUND:
        return df.groupBy(*by).agg(*[F.percentile(value, p).alias(o) for o, p in probs.items()])
    rows = materialise(df.where(F.col(value).isNotNull()).select(*by, value), "quantile-rows")
    found = materialise(_near_quantiles(rows, by, value, list(probs.values()), ranges), "quantiles")
    missed = F.lit(False)
    for i in range(len(probs)):
        missed = missed | F.col(f"_{i}").isNull()
    if not found.where(missed).where(F.col("_n") > 0).isEmpty():
        return _ranked_quantiles(rows, by, value, probs, ranges)
    return found.select(*by, *[F.col(f"_{i}").alias(o) for i, o in enumerate(probs)])


def _near_quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], ranges: int) -> DataFrame:
    """(by, _n, _0, _1, ...): rows of each group and its quantiles, NULL where the sketched values do not enclose one."""
    v, slack = F.col(value), 2.0 / SKETCH  # twice the sketch's error, on either side
    sides = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)]
    cuts = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"), F.percentile_approx(v, sides, SKETCH).alias("_cuts"))
    small = F.col("_n") <= 2 * SKETCH
    ends = [(F.when(small, F.col("_low")).otherwise(F.col("_cuts")[2 * i]), F.when(small, F.col("_high")).otherwise(F.col("_cuts")[2 * i + 1])) for i in range(len(probs))]
    cuts = materialise(cuts.select(*by, "_n", *[e.alias(f"_{side}{i}") for i, both in enumerate(ends) for side, e in zip(("from", "to"), both, strict=True)]), "quantile-cuts")
    placed = _attach(rows, cuts, by)
    under = placed.groupBy(*by).agg(F.count("*").alias("_n"), *[F.count_if(v < F.col(f"_from{i}")).alias(f"_under{i}") for i in range(len(probs))])
    inside = F.array_compact(F.array(*[F.when(v.between(F.col(f"_from{i}"), F.col(f"_to{i}")), F.lit(i)) for i in range(len(probs))]))
    near = counted_ranks(placed.select(*by, value, F.explode(inside).alias("_which")), [*by, "_which"], value, ranges).drop("_n")
    near = near.withColumnRenamed(value, "_v")
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        start = F.col(f"_under{i}") + F.col("_before")
        for tag, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("_which") == i) & (start <= k) & (k < start + F.col("_c")), F.col("_v"))).alias(f"_{tag}{i}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f{i}"))
    found = _attach(near, under, by).groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    return found.select(*by, "_n", *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"_{i}") for i in range(len(probs))])


def _ranked_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], ranges: int) -> DataFrame:
    """The quantiles from the ranks of all rows."""
    counted = counted_ranks(df, by, value, ranges)
    aggs = []
    for o, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for tag, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{tag}_{o}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{o}"))
    found = counted.groupBy(*by).agg(*aggs)
    return found.select(*by, *[
        (F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_f_{o}")).alias(o) for o in probs])


