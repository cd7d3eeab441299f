"""Expected returns, shrunk covariance, candidate weights, backtests and risk scores.

`wide` is the return table of a configured universe: one row per session, one column per asset. Matrices
have one row per asset pair of that universe, so their size is fixed by configuration, not by data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.config import TRADING_DAYS, PortfolioConfig
from loomspan.functions.expr import div, drawn
from loomspan.operators.stats import pair_stats

YEAR = math.sqrt(TRADING_DAYS)


def melt_assets(wide: DataFrame, assets: list[str], value: str = "r") -> DataFrame:
    return wide.unpivot("Date", assets, "Ticker", value)


def historical_mu(wide: DataFrame, assets: list[str]) -> DataFrame:
    means = wide.agg(*[(F.avg(f"`{a}`") * TRADING_DAYS).alias(a) for a in assets])
    return means.unpivot([], assets, "Ticker", "mu")


def recent_rows(df: DataFrame, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows within `days` civil days of as_of (default: the last date of the table)."""
    last = df.agg(F.max("Date").alias("d")).scalar() if as_of is None else as_of
    kept = df.where(F.col("Date") >= F.date_sub(last, days))
    return kept if as_of is None else kept.where(F.col("Date") <= as_of)


def model_mu(predictions: DataFrame, cfg: PortfolioConfig = PortfolioConfig(), as_of: Column | None = None) -> DataFrame:
    """Mean forecast of the recent rows compounded over the horizon and annualised."""
    daily = recent_rows(predictions, cfg.recent_days, as_of).groupBy("Ticker").agg(
        F.avg("Predicted_Return").alias("_d"))
    return daily.select("Ticker", (F.expm1(F.col("_d") * cfg.horizon) * (TRADING_DAYS / cfg.horizon)).alias("mu"))


def blended_mu(hist: DataFrame, model: DataFrame, model_weight: float) -> DataFrame:
    """(1-w)*historical + w*model where both exist, else historical."""
    both = hist.join(model.withColumnRenamed("mu", "_model"), "Ticker", "left")
    mixed = (1.0 - model_weight) * F.col("mu") + model_weight * F.col("_model")
    return both.select("Ticker", F.coalesce(mixed, F.col("mu")).alias("mu"))


def window_split(wide: DataFrame, cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """Adds Part: the last backtest_days sessions are 'oos', everything earlier 'est'."""
    from_end = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("Date")))
    return wide.withColumn("Part", F.when(from_end <= cfg.backtest_days, "oos").otherwise("est"))


def ledoit_wolf(wide: DataFrame, assets: list[str]) -> DataFrame:
    """(asset_i, asset_j, cov, shrinkage): covariance shrunk to a scaled identity, annualised.

    Everything comes from two sums per asset pair over the centred returns: S = mean(xi*xj) and
    q = sum(xi^2*xj^2); the shrinkage formula is applied to the pair table.
    """
    p = float(len(assets))
    means = wide.agg(*[F.avg(f"`{a}`").alias(a) for a in assets])
    centred = wide.select("Date", *[(F.col(f"`{a}`") - means.select(f"`{a}`").scalar()).alias(a) for a in assets])
    pairs = pair_stats(centred, assets, {
        "S": lambda a, b: F.avg(a * b), "q": lambda a, b: F.sum(a * a * b * b), "n": lambda a, b: F.count(a)},
        diagonal=True)
    times = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    total = pairs.agg(
        F.sum(times * F.col("S") * F.col("S")).alias("s2"), F.sum(times * F.col("q")).alias("q"),
        F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.col("S"))).alias("tr"), F.max("n").alias("n"))
    mu = F.col("tr") / p
    delta = (F.col("s2") - 2.0 * mu * F.col("tr") + p * mu * mu) / p
    beta = F.least((F.col("q") / F.col("n") - F.col("s2")) / (F.col("n") * p), delta)
    shrink = total.select(F.coalesce(div(beta, delta), F.lit(0.0)).alias("s"), mu.alias("mu"))
    out = pairs.select("asset_i", "asset_j", "S").withColumns(
        {"shrinkage": shrink.select("s").scalar(), "_mu": shrink.select("mu").scalar()})
    diag = F.when(F.col("asset_i") == F.col("asset_j"), F.col("_mu")).otherwise(0.0)
    return out.select(
        "asset_i", "asset_j",
        (((1.0 - F.col("shrinkage")) * F.col("S") + F.col("shrinkage") * diag) * TRADING_DAYS).alias("cov"),
        "shrinkage")


def normalised_weights(weights: DataFrame, column: str) -> DataFrame:
    """Weights divided by their sum; equal weights when the sum is not positive."""
    total = weights.agg(F.sum(column).alias("s")).scalar()
    n = weights.agg(F.count("*").alias("n")).scalar()
    return weights.select("Ticker", F.when(total > 0, F.col(column) / total).otherwise(1.0 / n).alias("w"))


def quadratic(weights: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """One row: w'mu, w'Sw and its root. `cov` has one row per unordered pair."""
    wi = weights.select(F.col("Ticker").alias("asset_i"), F.col("w").alias("wi"))
    wj = weights.select(F.col("Ticker").alias("asset_j"), F.col("w").alias("wj"))
    times = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    var = cov.join(wi, "asset_i").join(wj, "asset_j").agg(
        F.sum(times * F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))
    ret = weights.join(mu, "Ticker").agg(F.sum(F.col("w") * F.col("mu")).alias("expected_return"))
    return var.select(ret.scalar().alias("expected_return"), "variance", F.sqrt("variance").alias("volatility"))


def candidate_weights(spark: SparkSession, assets: list[str], cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """(Candidate, w): long-only capped weight arrays from independent hashed draws, so they can be reproduced.

    Weights over the cap are set to it and the rest is scaled to fill the budget; each round fixes at least
    one more asset, so as many rounds as assets suffice. The rounds are an array fold inside the JVM.
    """
    n, cap = len(assets), F.lit(cfg.cap)

    c = F.col("Candidate")
    parts = F.array(*[(drawn(cfg.seed, c, k) + 1).cast("double") for k in range(n)])

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def rescale(w: Column, _: Column) -> Column:
        capped = F.size(F.filter(w, lambda x: x >= cap))
        free = total(F.filter(w, lambda x: x < cap))
        spread = F.transform(w, lambda x: F.when(x >= cap, cap).otherwise(x * (1.0 - cap * capped) / free))
        return F.when((F.array_max(w) > cap + 1e-12) & (free > 0), spread).otherwise(w)

    start = spark.range(cfg.candidates).withColumnRenamed("id", "Candidate").withColumn("_p", parts)
    share = start.withColumn("_p", F.transform("_p", lambda x: x / total(F.col("_p"))))
    return share.select("Candidate", F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.col("_p"), rescale).alias("w"))


def score_candidates(candidates: DataFrame, assets: list[str], mu: DataFrame, cov: DataFrame,
                     risk_free: float) -> DataFrame:
    """(Candidate, w, ret, vol, sharpe). mu and cov of the universe enter as scalar arrays: no pair join."""
    at = {a: i for i, a in enumerate(assets)}
    mu_map = mu.agg(F.map_from_entries(F.collect_list(F.struct("Ticker", "mu"))).alias("m")).scalar()
    key = F.concat_ws("|", "asset_i", "asset_j")
    cov_map = cov.agg(F.map_from_entries(F.collect_list(F.struct(key, "cov"))).alias("m")).scalar()
    w = F.col("w")
    held = candidates.withColumns({"_mu": mu_map, "_cov": cov_map})
    ret = sum((w[i] * F.col("_mu")[a] for a, i in at.items()), F.lit(0.0))
    var = sum(((1.0 if a == b else 2.0) * w[at[a]] * w[at[b]] * F.col("_cov")[f"{a}|{b}"]
               for i, a in enumerate(assets) for b in assets[i:]), F.lit(0.0))
    scored = held.select("Candidate", "w", ret.alias("ret"), F.sqrt(var).alias("vol"))
    return scored.withColumn("sharpe", div(F.col("ret") - risk_free, F.col("vol")))


def weight_search(scored: DataFrame, assets: list[str]) -> DataFrame:
    """Two rows: the candidate of highest Sharpe ratio and the one of lowest volatility."""
    row = F.struct("Candidate", "w", "ret", "vol", "sharpe")
    best = scored.agg(F.max_by(row, F.struct("sharpe", -F.col("Candidate"))).alias("a"),
                      F.min_by(row, F.struct("vol", "Candidate")).alias("b"))
    rows = F.array(F.struct(F.lit("max_sharpe").alias("Goal"), F.col("a").alias("r")),
                   F.struct(F.lit("min_variance").alias("Goal"), F.col("b").alias("r")))
    got = best.select(F.explode(rows).alias("x")).select("x.Goal", "x.r.*")
    return got.select("Goal", "Candidate", "ret", "vol", "sharpe",
                      *[F.col("w")[i].alias(f"w_{a}") for i, a in enumerate(assets)])


def frontier(scored: DataFrame, cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """Highest return with variance at or below each target 0.02 + i*0.0055.

    Each candidate falls into the first target it satisfies; a running best over that table of at
    most frontier_points rows gives the rest.
    """
    var = F.col("vol") * F.col("vol")
    step = F.greatest(F.lit(0), F.ceil((var - 0.02) / 0.0055 - 1e-12)).cast("int")
    binned = scored.where(F.col("vol").isNotNull()).withColumn("i", step).where(F.col("i") < cfg.frontier_points).groupBy("i").agg(
        F.max_by(F.struct("ret", "vol"), F.struct("ret", -F.col("Candidate"))).alias("b"))
    points = scored.sparkSession.range(cfg.frontier_points).select(F.col("id").cast("int").alias("i"))
    upto = Window.partitionBy(F.lit(1)).orderBy("i")
    point = F.struct(F.col("b.ret").alias("ret"), (-F.col("b.vol")).alias("neg_vol"))
    best = F.max(F.when(F.col("b").isNotNull(), point)).over(upto)
    got = points.join(binned, "i", "left").select("i", best.alias("t")).where("t is not null")
    ret, vol = F.col("t").getField("ret"), -F.col("t").getField("neg_vol")
    return got.select((0.02 + F.col("i") * 0.0055).alias("Target_Variance"), vol.alias("Volatility"),
                      ret.alias("Return"), div(ret, vol).alias("Sharpe"))


def cap_feasible(n_assets: int, cap: float) -> str | None:
    """None when a fully invested long-only portfolio exists under the cap, else the reason."""
    reach = n_assets * cap
    return None if reach >= 1.0 - 1e-9 else f"cap {cap:.0%} on {n_assets} assets reaches only {reach:.0%}"


def strategy_returns(long: DataFrame, weights: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(Strategy, Date, r): fixed weights, equal weights and the benchmark over the same dates.

    `weights` (Ticker, w) has one row per asset of the universe and is broadcast.
    """
    held = normalised_weights(weights, "w")
    per_day = long.join(F.broadcast(held), "Ticker").groupBy("Date").agg(
        F.sum(F.col("w") * F.col("r")).alias("optimised"), F.avg("r").alias("equal_weight"))
    names = ["optimised", "equal_weight"]
    if benchmark is not None:
        per_day = per_day.join(benchmark.select("Date", F.col("r").alias("benchmark_buy_hold")), "Date", "left")
        names.append("benchmark_buy_hold")
    return per_day.unpivot("Date", names, "Strategy", "r").where(F.col("r").isNotNull())


def drawdown_curve(returns: DataFrame, by: str) -> DataFrame:
    """(by, Date, Value, Drawdown): compounded value and its distance from the running peak.

    One row per session in each group.
    """
    upto = Window.partitionBy(by).orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    valued = returns.withColumn("Value", F.product(1.0 + F.col("r")).over(upto))
    return valued.select(by, "Date", "r", "Value", (F.col("Value") / F.max("Value").over(upto) - 1.0).alias("Drawdown"))


def _excess(risk_free: float) -> Column:
    return F.col("r") - risk_free / TRADING_DAYS


def sharpe_agg(risk_free: float) -> Column:
    e = _excess(risk_free)
    return F.coalesce(div(F.avg(e), F.stddev_samp(e)), F.lit(0.0)) * YEAR


def sortino_agg(risk_free: float, mar: float = 0.0) -> Column:
    e = _excess(risk_free) - mar
    down = F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), 2.0)))
    return F.coalesce(div(F.avg(e), down), F.lit(0.0)) * YEAR


def sharpe(returns: DataFrame, by: str, risk_free: float) -> DataFrame:
    return returns.groupBy(by).agg(sharpe_agg(risk_free).alias("sharpe"), F.count("r").alias("n"))


def sortino(returns: DataFrame, by: str, risk_free: float) -> DataFrame:
    return returns.groupBy(by).agg(sortino_agg(risk_free).alias("sortino"), F.count("r").alias("n"))


def calmar(returns: DataFrame, by: str) -> DataFrame:
    """Annual mean over the deepest drawdown; NULL when there is none."""
    return drawdown_curve(returns, by).groupBy(by).agg(
        F.min("Drawdown").alias("max_drawdown"),
        div(F.avg("r") * TRADING_DAYS, F.abs(F.min("Drawdown"))).alias("calmar"))


def score_strategy(returns: DataFrame, by: str, risk_free: float) -> DataFrame:
    """The nine scores of each strategy: one window for the value curve, one aggregate."""
    curve = drawdown_curve(returns, by)
    final = F.max_by("Value", "Date")
    n = F.count("*")
    worst = F.min("Drawdown")
    return curve.groupBy(by).agg(
        (final - 1.0).alias("total_return"),
        (F.pow(final, TRADING_DAYS / n) - 1.0).alias("annualised_return"),
        (F.stddev_samp("r") * YEAR).alias("annualised_volatility"),
        sharpe_agg(risk_free).alias("sharpe"),
        sortino_agg(risk_free).alias("sortino"),
        worst.alias("max_drawdown"),
        div(F.avg("r") * TRADING_DAYS, F.abs(worst)).alias("calmar"),
        F.percentile("r", 0.05).alias("var_95"),
        final.alias("final_value"),
    )


def portfolio_beta(strategies: DataFrame, strategy: str, benchmark: str) -> DataFrame:
    s = strategies.where(F.col("Strategy") == strategy).select("Date", F.col("r").alias("s"))
    b = strategies.where(F.col("Strategy") == benchmark).select("Date", F.col("r").alias("b"))
    return s.join(b, "Date").agg(F.count("*").alias("n"), F.regr_slope("s", "b").alias("beta"))


def block_bootstrap(series: DataFrame, cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """One row: mean, standard error and 95 % interval of the Sharpe ratio over resampled blocks.

    `series` is (Date, r). The sums of every possible block are computed once by a trailing window; a resample
    then joins n/block block sums instead of n returns. Block starts are independent hashed draws, so the
    resamples can be reproduced. A series no longer than one block gives NULLs.
    """
    spark, b = series.sparkSession, cfg.block
    order = Window.partitionBy(F.lit(1)).orderBy("Date")
    ahead = order.rowsBetween(0, b - 1)
    e = F.col("r") - cfg.risk_free / TRADING_DAYS
    blocks = series.where(F.col("r").isNotNull()).select(
        (F.row_number().over(order) - 1).alias("start"),
        F.sum(e).over(ahead).alias("s1"), F.sum(e * e).over(ahead).alias("s2"))
    n = series.where(F.col("r").isNotNull()).agg(F.count("r").alias("n")).scalar()
    picks = (
        spark.range(cfg.resamples).withColumnRenamed("id", "b").withColumn("n", n).where(F.col("n") > b)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / b) - 1)))
        .select("b", (drawn(cfg.seed, F.col("b"), F.col("j")) % (F.col("n") - b + 1)).alias("start"))
    )
    m = F.count("*") * b
    mean = F.sum("s1") / m
    var = (F.sum("s2") - m * mean * mean) / (m - 1)
    each = picks.join(blocks, "start").groupBy("b").agg(
        F.coalesce(div(mean, F.sqrt(var)), F.lit(0.0)).alias("raw")).select((F.col("raw") * YEAR).alias("sharpe"))
    point = series.agg(sharpe_agg(cfg.risk_free).alias("p")).scalar()
    return each.agg(
        F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("std_error"),
        F.percentile("sharpe", 0.025).alias("ci_low"), F.percentile("sharpe", 0.975).alias("ci_high"),
        F.count("*").alias("n_bootstraps"),
    ).withColumn("point_estimate", point)


