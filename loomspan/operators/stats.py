"""Moments, distribution, risk and matrix statistics as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import TRADING_DAYS
from loomspan.functions.expr import by_series, corr, div, normal_pdf, normal_quantile
from loomspan.operators.ranking import quantiles
from loomspan.session import materialise

PAIRS = 64  # pair expressions that one aggregate evaluates


def log_returns(panel: DataFrame) -> DataFrame:
    lp = F.ln("AdjClose")
    return panel.select("Date", "Ticker", (lp - F.lag(lp).over(by_series())).alias("r")).where(F.col("r").isNotNull())


def moments(returns: DataFrame) -> DataFrame:
    return returns.groupBy("Ticker").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.var_pop("r").alias("variance"),
        (F.stddev_pop("r") * math.sqrt(TRADING_DAYS)).alias("annual_vol"),
        (F.avg("r") * TRADING_DAYS).alias("annual_mean"))


def skew_kurt_jb(returns: DataFrame) -> DataFrame:
    """Population skewness, excess kurtosis, Jarque-Bera statistic and its chi-square(2) p-value."""
    s, k, n = F.col("skew"), F.col("excess_kurtosis"), F.col("n")
    return (
        returns.groupBy("Ticker")
        .agg(F.count("r").alias("n"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("excess_kurtosis"))
        .withColumn("jb", n / 6.0 * (s * s + k * k / 4.0))
        .withColumn("p_value", F.exp(-F.col("jb") / 2.0))
    )


def histogram(returns: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins over [min, max] (the maximum belongs to the last bin) with the normal density overlay."""
    b = returns.agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("mean"),
                    F.stddev_samp("r").alias("sd"), F.count("r").alias("n"))
    lo, hi, mean, sd = (b.select(c).scalar() for c in ("lo", "hi", "mean", "sd"))
    width = (hi - lo) / bins
    bucket = F.least(F.lit(bins - 1), F.floor(div(F.col("r") - lo, width)).cast("int"))
    counts = returns.select(bucket.alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    mid = lo + (F.col("bin") + 0.5) * width
    return counts.select("bin", "count", mid.alias("mid"), normal_pdf(mid, mean, sd).alias("normal_density"))


def var_cvar(returns: DataFrame, by: list[str], alpha: float = 0.05, group_bound: int | None = None) -> DataFrame:
    """Empirical value at risk (linear interpolation) and the mean of the returns at or below it."""
    if group_bound is None:  # read for the quantile and for the tail
        returns = materialise(returns.select(*by, "r"), "tail-rows")
    var = quantiles(returns, by, "r", {"var": alpha}, group_bound)
    if not by:
        cut = var.select("var").scalar()
        return returns.agg(F.max(cut).alias("var"), F.avg(F.when(F.col("r") <= cut, F.col("r"))).alias("cvar"))
    return returns.join(var, by).groupBy(*by).agg(
        F.max("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"))


def wide_returns(panel: DataFrame, tickers: tuple[str, ...]) -> DataFrame:
    """Date plus one log-return column per named series, over the dates on which all of them have a price."""
    prices = panel.where(F.col("Ticker").isin(list(tickers))).groupBy("Date").agg(
        *[F.max(F.when(F.col("Ticker") == t, F.col("AdjClose"))).alias(t) for t in tickers]
    ).dropna()
    w = Window.partitionBy(F.lit(1)).orderBy("Date")
    return prices.select(
        "Date", *[(F.ln(F.col(f"`{t}`")) - F.lag(F.ln(F.col(f"`{t}`"))).over(w)).alias(t) for t in tickers]
    ).dropna()


def _pairs(names: list[str], diagonal: bool) -> list[list[tuple[str, str]]]:
    """Pairs i <= j (or i < j) in batches that one aggregate can hold."""
    every = [(a, b) for i, a in enumerate(names) for b in names[i if diagonal else i + 1:]]
    return [every[k:k + PAIRS] for k in range(0, len(every), PAIRS)]


def pair_stats(wide: DataFrame, names: list[str], measures: dict[str, object], diagonal: bool = False) -> DataFrame:
    """(asset_i, asset_j, <measures>) for each pair of the named columns.

    The columns of a configured universe sit side by side, so a pair statistic is one aggregate
    over the date rows with a map-side part: no self-join and no pair rows before the aggregate. A long
    list of names is cut into batches of pairs, one aggregate each over the table written once.
    """
    out = None
    batches = _pairs(names, diagonal)
    wide = materialise(wide.select(*[f"`{n}`" for n in names]), "pairs") if len(batches) > 1 else wide
    for batch in batches:
        rows = [F.struct(F.lit(a).alias("asset_i"), F.lit(b).alias("asset_j"),
                         *[fn(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(m) for m, fn in measures.items()])
                for a, b in batch]
        part = wide.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out


def corr_matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    return pair_stats(wide, names, {"corr": corr})


def cov_matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    return pair_stats(wide, names, {"cov": F.covar_samp}, diagonal=True)


def max_offdiag(corr: DataFrame) -> DataFrame:
    return corr.agg(F.max(F.abs("corr")).alias("max_abs_corr"))


def ranked_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    """Average ranks of each column over the date rows: the input of a Spearman matrix."""
    out = wide
    for c in names:
        order = Window.partitionBy(F.lit(1)).orderBy(F.col(f"`{c}`"))
        ties = Window.partitionBy(F.col(f"`{c}`"))
        out = out.withColumn(f"_{c}", F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0)
    return out.select("Date", *[F.col(f"`_{c}`").alias(c) for c in names])


def beta_ols(returns: DataFrame, benchmark: str) -> DataFrame:
    """Population covariance over population variance against the benchmark, per series."""
    bench = returns.where(F.col("Ticker") == benchmark).select("Date", F.col("r").alias("m"))
    both = returns.where(F.col("Ticker") != benchmark).join(F.broadcast(bench), "Date")
    return both.groupBy("Ticker").agg(
        F.count("*").alias("n"), F.covar_pop("r", "m").alias("covariance"), corr(F.col("r"), F.col("m")).alias("correlation"),
        div(F.covar_pop("r", "m"), F.var_pop("m")).alias("beta"))


def qq_points(returns: DataFrame) -> DataFrame:
    """Ordered sample against Filliben normal medians, per series, with the fitted line.

    Positions come from a window per series (bounded by the calendar).
    """
    w = Window.partitionBy("Ticker")
    i, n = F.row_number().over(w.orderBy("r", "Date")), F.count("*").over(w)
    last = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    median = (F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1.0 - last)
              .otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365)))
    pts = returns.select("Ticker", "Date", "r", i.alias("i"), n.alias("n")).withColumn(
        "theoretical", normal_quantile(median))
    line = pts.groupBy("Ticker").agg(F.regr_slope("r", "theoretical").alias("slope"),
                                     F.regr_intercept("r", "theoretical").alias("intercept"))
    return pts.join(line, "Ticker").select("Ticker", "i", "theoretical", "r", "slope", "intercept")


# Large-sample critical values of the unit-root t statistic with a constant.
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}


def adf_fixed_lag(panel: DataFrame, lags: int = 1) -> DataFrame:
    """Unit-root t statistic per series: dy on (1, y[-1], dy[-1..-lags]).

    The normal equations are sums in one aggregate per series; only the (lags + 2)-sized solve
    runs in Python, on one row per series. The statistic is NULL for a series that is too short, constant or
    without scatter around its fit.
    """
    w = by_series()
    y = F.col("AdjClose")
    diffs = panel.select("Date", "Ticker", (y - F.lag(y).over(w)).alias("d"), F.lag(y).over(w).alias("y1"))
    rows = diffs.select("Ticker", "d", "y1", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)],
                        "Date").dropna()
    centre = rows.groupBy("Ticker").agg(F.avg("y1").alias("_c"))
    shifted = rows.join(centre, "Ticker").withColumn("y1", F.col("y1") - F.col("_c"))
    x = [F.lit(1.0), F.col("y1"), *[F.col(f"d{k}") for k in range(1, lags + 1)]]
    k = len(x)
    sums = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]] + [F.sum(a * F.col("d")) for a in x]
    agg = shifted.groupBy("Ticker").agg(
        F.array(*sums, F.sum(F.col("d") * F.col("d")), F.count("*").cast("double")).alias("s"))

    def solve(batches):
        for pdf in batches:
            stats = [_adf_solve(np.asarray(s, dtype=float), k) for s in pdf["s"]]
            yield pd.DataFrame({"Ticker": pdf["Ticker"], "n": [int(s[-1]) for s in pdf["s"]],
                                "t_stat": pd.Series(stats, dtype=float)})

    solved = agg.mapInPandas(solve, "Ticker string, n long, t_stat double")
    solved = solved.withColumn("t_stat", F.nanvl("t_stat", F.lit(None).cast("double")))
    return solved.withColumns({f"reject_{p[:-1]}pct": F.col("t_stat") < c for p, c in ADF_CRITICAL.items()})


def _adf_solve(s: np.ndarray, k: int) -> float | None:
    n_pairs = k * (k + 1) // 2
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = s[:n_pairs]
    xx = xx + xx.T - np.diag(np.diag(xx))
    xy, yy, n = s[n_pairs:n_pairs + k], s[n_pairs + k], s[-1]
    if n <= k or np.linalg.matrix_rank(xx) < k:
        return None
    inv = np.linalg.inv(xx)
    coef = inv @ xy
    sigma2 = (yy - coef @ xy) / (n - k)
    scatter = sigma2 * inv[1, 1]
    return float(coef[1] / math.sqrt(scatter)) if scatter > 0 else None


