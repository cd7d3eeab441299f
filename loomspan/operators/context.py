"""Per-date context: market, macro and cross-sectional statistics, and how they join the panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomspan.config import EngineConfig
from loomspan.functions.expr import by_series, div, full

YEAR = math.sqrt(252.0)


def _one_series() -> WindowSpec:
    """Order of a table that holds one row per session of one series (bounded by the calendar)."""
    return Window.partitionBy("Ticker").orderBy("Date")


def market_context(panel: DataFrame, cfg: EngineConfig, macro: DataFrame | None = None) -> DataFrame:
    """One row per benchmark session: index returns, volatility index, yield spread and price momentum.

    `macro` is the long as-of grid (Date, Series, Value); series named DGS10, DGS3MO, CPIAUCSL and
    UNRATE are used where present.
    """
    w = _one_series()
    lp = F.ln("AdjClose")
    p = F.col("AdjClose")
    bench = panel.where(F.col("Ticker") == cfg.benchmark).select("Date", "Ticker", "AdjClose")
    ctx = (
        bench.withColumn("_r", lp - F.lag(lp).over(w))
        .select(
            "Date", "Ticker",
            F.col("_r").alias("Market_Return_1d"),
            (lp - F.lag(lp, 5).over(w)).alias("Market_Return_5d"),
            (lp - F.lag(lp, 21).over(w)).alias("Market_Return_21d"),
            (full(F.stddev_samp, F.col("_r"), 21, spec=w) * YEAR).alias("Market_Vol_21d"),
            div(p, F.first(p).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("Market_Cumulative"),
        )
    )
    vix = panel.where(F.col("Ticker") == cfg.volatility_index).select(
        "Date",
        F.col("Close").alias("VIX_Level"),
        (F.col("Close") - F.lag("Close").over(w)).alias("VIX_Change_1d"),
        full(F.avg, F.col("Close"), 21, spec=w).alias("VIX_MA_21"),
    )
    out = ctx.join(F.broadcast(vix), "Date", "left")
    if macro is not None:
        names = ["DGS10", "DGS3MO", "CPIAUCSL", "UNRATE"]
        wide = macro.groupBy("Date").pivot("Series", names).agg(F.first("Value"))
        spread = F.col("DGS10") - F.col("DGS3MO")
        cpi = F.col("CPIAUCSL")
        out = out.join(F.broadcast(wide), "Date", "left").withColumns({
            "Yield_Spread_10Y_3M": spread,
            "Yield_Spread_Change_21d": spread - F.lag(spread, 21).over(w),
            "CPI_Mom_12m": (div(cpi, F.lag(cpi, 252).over(w)) - 1) * 100.0,
            "CPI_Mom_1m": (div(cpi, F.lag(cpi, 21).over(w)) - 1) * 100.0,
        })
    return out.drop("Ticker")


def sessions(panel: DataFrame) -> DataFrame:
    """(SIdx, Date): position of each date that occurs in the panel. Bounded by civil days."""
    days = panel.agg(F.sort_array(F.collect_set("Date")).alias("d"))
    return days.select(F.posexplode("d").alias("SIdx", "Date"))


def session_returns(panel: DataFrame) -> DataFrame:
    """(Date, SIdx, Ticker, r): log return against the previous session, NULL after a gap."""
    lp = F.ln("AdjClose")
    w = Window.partitionBy("Ticker").orderBy("SIdx")
    step = F.col("SIdx") - F.lag("SIdx").over(w)
    return panel.select("Date", "Ticker", "AdjClose").join(F.broadcast(sessions(panel)), "Date").select(
        "Date", "SIdx", "Ticker", F.when(step == 1, lp - F.lag(lp).over(w)).alias("r"))


def market_returns(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(Date, m, m_var): benchmark return and its trailing variance, one row per session."""
    only = session_returns_of(panel, cfg.benchmark)
    span = Window.partitionBy("Ticker").orderBy("SIdx").rangeBetween(-(cfg.beta_window - 1), 0)
    var = F.when(F.count("r").over(span) >= cfg.beta_min_periods, F.var_samp("r").over(span))
    return only.select("Date", F.col("r").alias("m"), var.alias("m_var"))


def session_returns_of(panel: DataFrame, ticker: str) -> DataFrame:
    """session_returns of one series; the session positions still come from the whole panel."""
    lp = F.ln("AdjClose")
    w = Window.partitionBy("Ticker").orderBy("SIdx")
    one = panel.where(F.col("Ticker") == ticker).select("Date", "Ticker", "AdjClose")
    step = F.col("SIdx") - F.lag("SIdx").over(w)
    return one.join(F.broadcast(sessions(panel)), "Date").select(
        "Date", "SIdx", "Ticker", F.when(step == 1, lp - F.lag(lp).over(w)).alias("r"))


def breadth_dispersion(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per date: mean return, share of names up (of all names seen, a NULL return is not up), dispersion."""
    mine = F.col("Ticker").isin(list(cfg.universe))
    names = panel.where(mine).agg(F.countDistinct("Ticker").alias("n")).scalar()
    r = F.when(mine, F.col("r"))
    return (
        session_returns(panel).groupBy("Date")
        .agg(
            F.avg(r).alias("Cross_Section_Return"),
            F.count_if(r > 0).alias("_up"),
            F.stddev_samp(r).alias("Universe_Dispersion"),
        )
        .select("Date", "Cross_Section_Return", (F.col("_up") / names).alias("Universe_Breadth"), "Universe_Dispersion")
    )


def rolling_peer(breadth: DataFrame) -> DataFrame:
    """Five-session sums over the per-date table (one row per session, so one small ordered window)."""
    w = Window.partitionBy(F.lit(1)).orderBy("Date")
    return breadth.withColumns({
        "Peer_Mean_Return_5d": full(F.sum, F.col("Cross_Section_Return"), 5, spec=w),
        "Universe_Dispersion_5d": full(F.avg, F.col("Universe_Dispersion"), 5, spec=w),
    })


def rolling_beta(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(Date, Ticker, r, m, Beta) for the universe: trailing covariance with the benchmark over its variance."""
    mine = session_returns(panel).where(F.col("Ticker").isin(list(cfg.universe)))
    both = mine.join(F.broadcast(market_returns(panel, cfg)), "Date", "left")
    span = Window.partitionBy("Ticker").orderBy("SIdx").rangeBetween(-(cfg.beta_window - 1), 0)
    pairs = F.count(F.col("r") + F.col("m")).over(span)
    cov = F.when(pairs >= cfg.beta_min_periods, F.covar_samp("r", "m").over(span))
    return both.select("Date", "SIdx", "Ticker", "r", "m", div(cov, F.col("m_var")).alias("Beta"))


def idiosyncratic(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(Date, Ticker, Beta, Idiosyncratic, Idiosyncratic_5d, Relative_Strength), long."""
    peers = breadth_dispersion(panel, cfg).select("Date", "Cross_Section_Return")
    base = rolling_beta(panel, cfg).withColumn("Idiosyncratic", F.col("r") - F.col("m") * F.col("Beta"))
    span = Window.partitionBy("Ticker").orderBy("SIdx").rangeBetween(-4, 0)
    five = F.when(F.count("Idiosyncratic").over(span) == 5, F.sum("Idiosyncratic").over(span))
    return base.withColumn("Idiosyncratic_5d", five).join(F.broadcast(peers), "Date", "left").select(
        "Date", "Ticker", "Beta", "Idiosyncratic", "Idiosyncratic_5d",
        (F.col("r") - F.col("Cross_Section_Return")).alias("Relative_Strength"))


def cross_moments(idio: DataFrame) -> DataFrame:
    """Per date: moments of the idiosyncratic returns, spread of relative strength, mean beta."""
    return idio.groupBy("Date").agg(
        F.avg("Idiosyncratic").alias("Idiosyncratic_Mean"),
        F.stddev_samp("Idiosyncratic").alias("Idiosyncratic_Dispersion"),
        F.avg("Relative_Strength").alias("Relative_Strength_Mean"),
        (F.max("Relative_Strength") - F.min("Relative_Strength")).alias("Relative_Strength_Spread"),
        F.avg("Beta").alias("Beta_Cross_Section_Mean"),
    )


def cross_sectional_context(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per date: breadth, five-session sums, moments and the per-name columns, pivoted last."""
    idio = idiosyncratic(panel, cfg)
    cols = {"Beta": "Beta_{t}", "Idiosyncratic": "Idiosyncratic_{t}",
            "Idiosyncratic_5d": "Idiosyncratic_{t}_5d", "Relative_Strength": "Relative_Strength_{t}"}
    per_name = idio.groupBy("Date").agg(
        F.avg("Idiosyncratic").alias("Idiosyncratic_Mean"),
        F.stddev_samp("Idiosyncratic").alias("Idiosyncratic_Dispersion"),
        F.avg("Relative_Strength").alias("Relative_Strength_Mean"),
        (F.max("Relative_Strength") - F.min("Relative_Strength")).alias("Relative_Strength_Spread"),
        F.avg("Beta").alias("Beta_Cross_Section_Mean"),
        *[F.max(F.when(F.col("Ticker") == t, F.col(c))).alias(name.format(t=t))
          for c, name in cols.items() for t in cfg.universe],
    )
    return rolling_peer(breadth_dispersion(panel, cfg)).join(per_name, "Date", "left")


def context_join(features: DataFrame, context: DataFrame) -> DataFrame:
    """Context has one row per session, so its size is bounded by the calendar and it is broadcast."""
    return features.join(F.broadcast(context), "Date", "left")


def rebased_price(panel: DataFrame) -> DataFrame:
    first = F.first("AdjClose").over(by_series().rowsBetween(Window.unboundedPreceding, 0))
    return panel.select("Date", "Ticker", div(F.col("AdjClose"), first).alias("Rebased"))


