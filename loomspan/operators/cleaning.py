"""Cleaning of a raw price panel: repeats, calendar alignment, bounded forward fill, flags, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import CleanConfig
from loomspan.functions.expr import by_series, div, full
from loomspan.sources.readers import PRICE_FIELDS

KEY = ("Date", "Ticker")


def _missing_fields():
    return sum((F.col(c).isNull().cast("int") for c in PRICE_FIELDS), F.lit(0))


def dedup_best_record(prices: DataFrame, fewest_nulls: bool = True) -> DataFrame:
    """One row per (Date, Ticker): with an adjusted close first, then by number of missing fields.

    An aggregate instead of a row_number window: copies collapse before the shuffle, so a key
    with very many copies never meets in one sort. fewest_nulls=False prefers the most incomplete row.
    """
    nulls = _missing_fields()
    ties = [F.coalesce(F.col(c), F.lit(float("-inf"))) for c in PRICE_FIELDS]
    preference = F.struct(F.col("AdjClose").isNotNull(), -nulls if fewest_nulls else nulls, *ties)
    return (
        prices.groupBy(*KEY)
        .agg(F.max_by(F.struct(*PRICE_FIELDS), preference).alias("r"))
        .select(*KEY, "r.*")
    )


def duplicate_conflicts(prices: DataFrame) -> DataFrame:
    """Keys with more than one row and the fields that disagree (a NULL against a value disagrees)."""
    differs = {
        c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in PRICE_FIELDS
    }
    found = prices.groupBy(*KEY).agg(
        F.count("*").alias("Copies"), *[F.coalesce(e, F.lit(False)).alias(f"_{c}") for c, e in differs.items()]
    ).where(F.col("Copies") > 1)
    names = F.array_compact(F.array(*[F.when(F.col(f"_{c}"), F.lit(c)) for c in PRICE_FIELDS]))
    return found.select(*KEY, "Copies", F.concat_ws(",", names).alias("Differing")).where("Differing != ''")


def conflict_details(conflicts: DataFrame, n: int = 20) -> DataFrame:
    return conflicts.orderBy(*KEY).limit(n)


def session_list(prices: DataFrame, source: str) -> DataFrame:
    """One row, one column `sessions`: the sorted sessions of the calendar series (bounded by civil days)."""
    return prices.where(F.col("Ticker") == source).agg(F.sort_array(F.collect_set("Date")).alias("sessions"))


def trading_calendar(prices: DataFrame, source: str) -> DataFrame:
    """(SessionIdx, Date) of the calendar series."""
    return session_list(prices, source).select(F.posexplode("sessions").alias("SessionIdx", "Date"))


def align_calendar(prices: DataFrame, source: str) -> DataFrame:
    """Every series on every session of the calendar series: other days dropped, missing sessions NULL rows.

    The grid is not joined. Each row, in series order, fills the sessions between its
    predecessor and itself (the last row also those up to the end), which costs one exchange by series that
    the following per-series windows reuse. A calendar series without rows is an error.
    """
    known = session_list(prices, source).select(F.when(F.size("sessions") > 0, F.col("sessions")).otherwise(
        F.raise_error(F.lit(f"calendar series {source} has no rows")).cast("array<date>")).alias("sessions"))
    days = known.scalar()
    calendar = trading_calendar(prices, source)
    placed = prices.join(F.broadcast(calendar), "Date", "left").withColumn(
        "_slot", F.coalesce("SessionIdx", F.lit(-1)))
    order = Window.partitionBy("Ticker").orderBy("_slot", "Date")
    prev = F.coalesce(F.lag("_slot").over(order), F.lit(-1))
    last = F.lead("Ticker").over(order).isNull()
    spans = placed.select("Ticker", "_slot", *PRICE_FIELDS, prev.alias("_prev"), last.alias("_last")).select(
        "Ticker", "_slot", *PRICE_FIELDS,
        F.when(F.col("_slot") < 0, 0).otherwise(F.col("_prev") + 1).alias("_lo"),
        F.when(F.col("_last"), F.size(days) - 1).otherwise(F.col("_slot")).alias("_hi"),
    ).where("_lo <= _hi")
    slots = spans.select("*", F.explode(F.sequence("_lo", "_hi")).alias("_at"))
    own = F.col("_at") == F.col("_slot")
    return slots.select(
        F.element_at(days, F.col("_at") + 1).alias("Date"), "Ticker",
        *[F.when(own, F.col(c)).alias(c) for c in PRICE_FIELDS],
    )


def impute_gaps(aligned: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Carry each field forward over at most max_ffill sessions, never backward; then Volume NULL -> 0.

    The carried row keeps its carried volume; only what is still missing becomes 0. `Missing` marks rows
    that had no close before the fill.
    """
    recent = by_series().rowsBetween(-cfg.max_ffill, 0)
    carried = {c: F.last(c, ignorenulls=True).over(recent) for c in PRICE_FIELDS}
    carried["Volume"] = F.coalesce(carried["Volume"], F.lit(0.0))
    return aligned.withColumns({"Missing": F.col("Close").isNull(), "_idx": F.row_number().over(by_series()) - 1,
                                **carried})


def gap_accounting(imputed: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Per series: sessions missing before the fill, filled, remaining, and missing at the very start."""
    missing = F.sum(F.col("Missing").cast("long"))
    remaining = F.sum(F.col("Close").isNull().cast("long"))
    return imputed.groupBy("Ticker").agg(
        missing.alias("missing_before"),
        (missing - remaining).alias("filled"),
        remaining.alias("remaining"),
        F.sum((F.col("Missing") & (F.col("_idx") <= cfg.max_ffill)).cast("long")).alias("leading"),
    )


def rolling_zscore(panel: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Daily log return, its trailing z-score and the |z| flag."""
    lp = F.ln("AdjClose")
    out = panel.withColumn("Return", lp - F.lag(lp).over(by_series()))
    r = F.col("Return")
    mean = full(F.avg, r, cfg.z_window, cfg.z_min_periods)
    sd = full(F.stddev_samp, r, cfg.z_window, cfg.z_min_periods)
    return out.withColumn("Z_Score", div(r - mean, sd)).withColumn(
        "Outlier_Z", F.coalesce(F.abs("Z_Score") > cfg.z_threshold, F.lit(False)))


def iqr_fence(panel: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Whole-sample quartile fence per series. A flag only, never a model input: it looks ahead.

    The quartiles are taken over the rows of one series, which the calendar bounds.
    """
    quart = panel.groupBy("Ticker").agg(F.percentile("Return", [0.25, 0.75]).alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    span = (q3 - q1) * cfg.iqr_multiplier
    outside = (F.col("Return") < q1 - span) | (F.col("Return") > q3 + span)
    return (
        panel.join(quart, "Ticker", "left")
        .withColumn("Outlier_IQR", F.coalesce(outside, F.lit(False)))
        .withColumn("Outlier", F.col("Outlier_IQR") | F.col("Outlier_Z"))
        .drop("_q")
    )


def flag_outliers(panel: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    return iqr_fence(rolling_zscore(panel, cfg), cfg)


def outlier_summary(flagged: DataFrame) -> DataFrame:
    """Flag counts per series with a grand-total row (Ticker = 'ALL')."""
    return flagged.rollup("Ticker").agg(
        F.sum(F.col("Outlier_Z").cast("long")).alias("zscore"),
        F.sum(F.col("Outlier_IQR").cast("long")).alias("iqr"),
        F.sum(F.col("Outlier").cast("long")).alias("either"),
        F.count("*").alias("retained"),
    ).withColumn("Ticker", F.coalesce("Ticker", F.lit("ALL")))


def ohlc_violation():
    """Low <= min(Open, Close, High) and High >= max(Open, Close, Low), judged only where Close exists."""
    low, high = F.col("Low"), F.col("High")
    broken = (F.coalesce(low > F.least("Open", "Close", "High"), F.lit(False))
              | F.coalesce(high < F.greatest("Open", "Close", "Low"), F.lit(False)))
    return broken & F.col("Close").isNotNull()


def ohlc_violations(panel: DataFrame) -> DataFrame:
    return panel.where(ohlc_violation()).select(*KEY, "Open", "High", "Low", "Close")


def quarantine(panel: DataFrame) -> DataFrame:
    """All price fields of violating rows become NULL; the rows stay."""
    marked = panel.withColumn("_bad", ohlc_violation())
    return marked.withColumns({c: F.when(~F.col("_bad"), F.col(c)) for c in PRICE_FIELDS}).drop("_bad")


def drop_unusable(panel: DataFrame) -> DataFrame:
    return panel.dropna(subset=["Close", "AdjClose"])


def clean(raw: DataFrame, calendar_source: str, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """repeats -> alignment -> fill -> flags -> quarantine -> unusable rows, as one lazy plan."""
    imputed = impute_gaps(align_calendar(dedup_best_record(raw), calendar_source), cfg)
    return drop_unusable(quarantine(flag_outliers(imputed, cfg))).drop("Missing", "_idx")


def dq_row_accounting(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: rows in and out, surplus copies, series and sessions."""
    before = raw.agg(
        F.count("*").alias("rows_in"),
        F.countDistinct(*KEY).alias("keys_in"),
    )
    after = cleaned.agg(
        F.count("*").alias("rows_out"), F.countDistinct("Date").alias("sessions"),
        F.countDistinct("Ticker").alias("tickers"),
    )
    got = after.select("*", before.select("rows_in").scalar().alias("rows_in"),
                       before.select("keys_in").scalar().alias("keys_in"))
    return got.select(
        "rows_in", "rows_out", (F.col("rows_in") - F.col("keys_in")).alias("duplicates"), "sessions", "tickers",
        ((F.col("rows_out") - F.col("rows_in")) * 100.0 / F.col("rows_in")).alias("pct_change"),
    )


def asof_backward(releases: DataFrame, calendar: DataFrame) -> DataFrame:
    """Last released value at or before each session, per series (long in, long out).

    Releases and sessions are stacked and a running last value is taken in series order, so there is
    no inequality join. Before the first release the value is NULL; nothing is carried backward. A
    series holds at most one release and one session per civil day.
    """
    names = releases.agg(F.array_sort(F.collect_set("Series")).alias("s"))
    grid = calendar.select("Date", F.explode(names.scalar()).alias("Series"))
    stacked = (
        releases.select("Date", "Series", "Value", F.lit(False).alias("_keep"))
        .unionByName(grid.select("Date", "Series", F.lit(None).cast("double").alias("Value"), F.lit(True).alias("_keep")))
    )
    upto = Window.partitionBy("Series").orderBy("Date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.max_by("Value", F.when(F.col("Value").isNotNull(), F.col("Date"))).over(upto)
    return stacked.withColumn("Value", known).where("_keep").drop("_keep")


def key_union(calendar: DataFrame, releases: DataFrame) -> DataFrame:
    return calendar.select("Date").union(releases.select("Date")).distinct()


def melt_fields(panel: DataFrame) -> DataFrame:
    """Rows to (Date, Ticker, Field, Value) cells, missing cells dropped."""
    return panel.unpivot(list(KEY), list(PRICE_FIELDS), "Field", "Value").where(F.col("Value").isNotNull())


def melt_panel(wide: DataFrame, tickers: list[str], price_fields: list[str], flag_fields: list[str]) -> DataFrame:
    """Aligned wide frame ("<Field>|<Ticker>") to rows, flags NULL -> false, in one pass."""
    if len(set(wide.columns)) != len(wide.columns):
        raise ValueError("duplicate columns in the wide frame")
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("Ticker"),
            *[F.col(f"`{f}|{t}`").alias(f) for f in price_fields],
            *[F.coalesce(F.col(f"`{f}|{t}`"), F.lit(False)).alias(f) for f in flag_fields],
        )
        for t in tickers
    ])
    return wide.select("Date", F.explode(rows).alias("r")).select("Date", "r.*")


def pivot_prices(panel: DataFrame, tickers: list[str], value: str = "AdjClose") -> DataFrame:
    """Date x series matrix for a named list of series; the list makes the schema fixed and skips a scan."""
    return panel.groupBy("Date").pivot("Ticker", tickers).agg(F.first(value))
