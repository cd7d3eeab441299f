"""Sub-signals, fusion, actions, rebalancing and the three-arm recommendation backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import EngineConfig, PortfolioConfig, RecommendConfig
from loomspan.functions.expr import by_series, clip, corr, div, full
from loomspan.operators.evaluate import best_model
from loomspan.operators.portfolio import recent_rows
from loomspan.operators.ranking import WINDOW_BOUND, counted_ranks, normalise, normalise_window, quantiles, rank_pct
from loomspan.session import materialise

# Parts of the explanation text.
LEADS = {
    "BUY": "Composite clears the buy threshold:",
    "SELL": "Composite falls below the sell threshold:",
    "HOLD": "Composite sits inside the no-trade band:",
}
NO_EDGE = (" The forecast term carries zero weight because the model shows no measured edge over the "
           "random walk.")


def latest_per_key(df: DataFrame, key: str = "Ticker") -> DataFrame:
    """Last row of each key, as an aggregate with a map-side part."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "Date").alias("r")).select(key, "r.*")


def tail_n(df: DataFrame, n: int) -> DataFrame:
    """Last n rows of each series (a series is bounded by the calendar)."""
    order = Window.partitionBy("Ticker").orderBy(F.desc("Date"))
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def forecast_signal(predictions: DataFrame, cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """Mean forecast over the recent rows, scaled to the horizon."""
    return recent_rows(predictions, cfg.recent_days).groupBy("Ticker").agg(
        (F.avg("Predicted_Return") * cfg.horizon).alias("Forecast"))


def latest_sentiment(daily: DataFrame) -> DataFrame:
    return daily.groupBy("Ticker").agg(F.max_by("Sentiment_FinBERT", "Date").alias("Sentiment"))


def risk_signal(features: DataFrame, as_of: Column, betas: DataFrame | None = None,
                group_bound: int | None = None) -> DataFrame:
    """Rank of the volatility at as_of, averaged with the rank of beta where known; else 0.5.

    Without any row at as_of the last earlier row of each series is used.
    """
    upto = features.where(F.col("Date") <= as_of)
    newest = upto.agg(F.max("Date").alias("d")).scalar()
    last = upto.groupBy("Ticker").agg(F.max("Date").alias("_d"), F.max_by("Vol_21d", "Date").alias("_vol")).where(
        (F.col("_d") == as_of) | (newest < as_of))
    out = rank_pct(last.withColumn("_all", F.lit(1)), ["_all"], "_vol", "_v", group_bound)
    risk = F.col("_v")
    if betas is not None:
        known = rank_pct(betas.select("Ticker", "beta").withColumn("_all", F.lit(1)), ["_all"], "beta", "_b", group_bound)
        out = out.join(known.select("Ticker", "_b"), "Ticker", "left")
        risk = F.when(F.col("_b").isNotNull(), (risk + F.col("_b")) / 2.0).otherwise(risk)
    return out.select("Ticker", F.coalesce(risk, F.lit(0.5)).alias("Risk"))


def centre_rank(df: DataFrame, value: str, out: str, group_bound: int | None = None,
                by: list[str] | None = None) -> DataFrame:
    """Normalised rank moved from [0, 1] to [-1, 1]."""
    ranked = normalise(df, by or [], value, "_unit", group_bound)
    return ranked.withColumn(out, 2.0 * F.col("_unit") - 1.0).drop("_unit")


def fuse(weighted: list[tuple[Column, Column]]) -> Column:
    """Weighted mean of centred signals over the sum of absolute weights; 0 without any weight."""
    total = sum((F.abs(w) for w, _ in weighted), F.lit(0.0))
    score = sum((w * s for w, s in weighted), F.lit(0.0))
    return F.when(total <= 0, 0.0).otherwise(score / F.nullif(total, F.lit(0.0)))


def threshold_action(score: Column, low: float, high: float) -> Column:
    return (F.when(score.isNull() | F.isnan(score), "HOLD").when(score >= high, "BUY")
            .when(score <= low, "SELL").otherwise("HOLD"))


def skill_gate(predictions: DataFrame) -> DataFrame:
    """One row: relative error improvement over a zero forecast, clipped to [0, 1]; 0 for an empty table."""
    y = F.col("Actual_Return")
    base, err = F.avg(F.abs(y)), F.avg(F.abs(y - F.col("Predicted_Return")))
    return predictions.agg(F.coalesce(clip(div(base - err, base), 0.0, 1.0), F.lit(0.0)).alias("skill"))


def bucket_word(value: Column, high: str, low: str, middle: str) -> Column:
    return F.when(value > 0.66, high).when(value < 0.33, low).otherwise(middle)


def rationale(action: Column, f: Column, s: Column, r: Column, forecast_weight: Column) -> Column:
    lead = F.when(action == "BUY", LEADS["BUY"]).when(action == "SELL", LEADS["SELL"]).otherwise(LEADS["HOLD"])
    parts = F.concat_ws(
        "; ",
        F.format_string("forecast %s (%.2f)", bucket_word(f, "strong", "weak", "neutral"), f),
        F.format_string("sentiment %s (%.2f)", bucket_word(s, "positive", "negative", "neutral"), s),
        F.format_string("risk %s (%.2f)", bucket_word(r, "high", "low", "moderate"), r),
    )
    return F.concat(lead, F.lit(" "), parts, F.lit("."), F.when(forecast_weight <= 0, NO_EDGE).otherwise(""))


def universe_frame(universe: tuple[str, ...], df: DataFrame) -> DataFrame:
    """One row per configured name."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in universe])).alias("Ticker"))


def universe_default(universe: tuple[str, ...], signal: DataFrame, column: str, default: float = 0.5) -> DataFrame:
    """A row for every universe member; a missing signal becomes the default."""
    return universe_frame(universe, signal).join(signal.select("Ticker", column), "Ticker", "left").withColumn(
        column, F.coalesce(column, F.lit(default)))


def rebalance_plan(weights: DataFrame, band: float = 0.05) -> DataFrame:
    """(Ticker, weights, Drift, Action, Band_Breached); the band is strict, display values round half-even."""
    drift = F.col("Target_Weight") - F.col("Current_Weight")
    out = F.abs(drift) > band
    return weights.select(
        "Ticker", F.bround("Current_Weight", 4).alias("Current_Weight"), F.bround("Target_Weight", 4).alias("Target_Weight"),
        F.bround(drift, 4).alias("Drift"),
        F.when(out & (drift > 0), "INCREASE").when(out, "REDUCE").otherwise("HOLD").alias("Action"),
        out.alias("Band_Breached"))


def recommendations(predictions: DataFrame, features: DataFrame, sentiment: DataFrame | None, weights: DataFrame,
                    cfg: EngineConfig) -> DataFrame:
    """One row per universe member: action, composite, sub-signals, weights, drift and explanation.

    All ranks run over the configured universe, so they are plain windows over that many rows.
    """
    rc: RecommendConfig = cfg.recommend
    own = predictions.where(F.col("Model") == best_model(predictions))
    as_of = features.agg(F.max("Date").alias("d")).scalar()
    base = (
        universe_frame(cfg.universe, features).join(forecast_signal(own, cfg.portfolio), "Ticker", "left")
        .join(risk_signal(features, as_of, group_bound=len(cfg.universe)), "Ticker", "left")
        .join(F.broadcast(weights), "Ticker", "left")
    )
    known = latest_sentiment(sentiment) if sentiment is not None else base.select("Ticker", F.lit(0.5).alias("Sentiment"))
    half = F.lit(0.5)
    base = base.join(known, "Ticker", "left").select(
        "Ticker", F.coalesce("Forecast", half).alias("Forecast"), F.coalesce("Sentiment", half).alias("Sentiment"),
        F.coalesce("Risk", half).alias("Risk"), F.coalesce("Target_Weight", F.lit(0.0)).alias("_t"),
        F.coalesce("Current_Weight", F.lit(0.0)).alias("_w"), (rc.forecast * skill_gate(predictions).scalar()).alias("_wf"))
    unit = base.withColumns({
        "f": normalise_window(F.col("Forecast")), "s": normalise_window(F.col("Sentiment")),
        "r": normalise_window(F.col("Risk"))}).withColumn("_neg", -F.col("r"))
    centred = unit.withColumns({
        c: 2.0 * normalise_window(F.col(v)) - 1.0 for c, v in (("fc", "f"), ("sc", "s"), ("rc", "_neg"))})
    score = fuse([(F.col("_wf"), F.col("fc")), (F.lit(rc.sentiment), F.col("sc")), (F.lit(rc.risk), F.col("rc"))])
    joined = centred.withColumn("_c", score)
    action = threshold_action(F.col("_c"), rc.sell, rc.buy)
    drift = F.col("_t") - F.col("_w")
    return joined.select(
        "Ticker", action.alias("Recommendation"), F.bround("_c", 4).alias("Composite_Score"),
        F.bround("f", 4).alias("Forecast_Signal"), F.bround("s", 4).alias("Sentiment_Signal"),
        F.bround("r", 4).alias("Risk_Signal"), F.bround("_t", 4).alias("Target_Weight"),
        F.bround("_w", 4).alias("Current_Weight"), F.bround(drift, 4).alias("Drift"),
        F.when(drift > rc.band, "INCREASE").when(drift < -rc.band, "REDUCE").otherwise("MAINTAIN").alias("Rebalance"),
        rationale(action, F.col("f"), F.col("s"), F.col("r"), F.col("_wf")).alias("Rationale"),
    ).orderBy(F.desc("Composite_Score"), "Ticker")


def melt_signals(recs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(Ticker, Component, Normalised, Weight, Signed); risk counts negative."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return recs.unpivot("Ticker", list(weights), "Component", "Normalised").withColumn(
        "Weight", w[F.col("Component")]
    ).withColumn("Signed", F.when(F.col("Component") == "Risk_Signal", -1.0).otherwise(1.0)
                 * F.col("Weight") * F.col("Normalised"))


def action_counts(recs: DataFrame, column: str = "Recommendation") -> DataFrame:
    return recs.groupBy(column).agg(F.count("*").alias("n"))


def forward_outcome(panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(Date, Ticker, keep, realised): log return to the next row of the same series, next to columns of the panel to keep."""
    lp = F.ln("AdjClose")
    return panel.select("Date", "Ticker", *keep, (F.lead(lp).over(by_series()) - lp).alias("realised"))


def trailing_risk(panel: DataFrame, group_bound: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(Date, Ticker, keep, Risk): -2*(rank of smoothed volatility - 0.5) - 4*stretch above the 50-row mean."""
    lp, p = F.ln("AdjClose"), F.col("AdjClose")
    a = panel.select("Date", "Ticker", *keep, "AdjClose", (lp - F.lag(lp).over(by_series())).alias("r"))
    b = a.withColumns({"sd": full(F.stddev_samp, F.col("r"), 21), "gap": div(p, full(F.avg, p, 50)) - 1.0})
    c = b.select("Date", "Ticker", *keep, full(F.avg, F.col("sd"), 63).alias("level"),
                 F.coalesce(full(F.avg, F.col("gap"), 10), F.lit(0.0)).alias("stretch"))
    ranked = rank_pct(c, ["Date"], "level", "pct", group_bound)
    return ranked.select("Date", "Ticker", *keep, (-(F.col("pct") - 0.5) * 2.0 - F.col("stretch") * 4.0).alias("Risk"))


def signal_outcome(forecasts: DataFrame, risk: DataFrame | None = None, outcome: DataFrame | None = None) -> DataFrame:
    """Forecast, risk and outcome on (Date, Ticker), rows missing any of them, or a part of the key, dropped.

    What the forecasts carry along (Risk, realised) needs no table of its own: such rows are met already and not moved for a join.
    """
    for other in (risk, outcome):
        forecasts = forecasts if other is None else forecasts.join(other, ["Date", "Ticker"])
    return forecasts.select("Date", "Ticker", F.col("Predicted_Return").alias("Forecast"), "Risk", "realised").dropna()


def ranked_signals(rows: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """(Date, Signal, Value, _place, _n): average rank of each value among those of its date and signal, and their number."""
    pairs = F.array(*[F.struct(F.lit(s).alias("Signal"), F.col(s).alias("Value")) for s in signals])
    long = rows.select("Date", F.explode(pairs).alias("p")).select("Date", "p.Signal", "p.Value")
    return counted_ranks(long, ["Date", "Signal"], "Value").select("Date", "Signal", "Value", (F.col("_before") + (F.col("_c") + 1) / 2.0).alias("_place"), "_n")


def backtest_actions(rows: DataFrame, cfg: RecommendConfig, skill: float, group_bound: int | None = None) -> DataFrame:
    """Adds one action (+1, 0, -1) per arm. Signals are ranked per date; risk enters the fusion negated.

    Ranking a rank again changes nothing, and the rank of a negated value is that of the value from the other end, so
    without a bound both signals are ranked once, in one table of (date, signal, value, count).
    """
    if group_bound is not None and group_bound <= WINDOW_BOUND:
        day = ["Date"]
        ranked = rows.withColumns({"f": normalise_window(F.col("Forecast"), day), "r": normalise_window(F.col("Risk"), day)})
        ranked = ranked.withColumn("_neg", -F.col("r")).withColumns(
            {c: 2.0 * normalise_window(F.col(v), day) - 1.0 for c, v in (("fc", "f"), ("rc", "_neg"))})
    else:
        rows = materialise(rows, "outcomes", lean=True)
        places = materialise(ranked_signals(rows, ("Forecast", "Risk")), "places", lean=True)

        def side(signal: str, place: str, last: str) -> DataFrame:
            return places.where(F.col("Signal") == signal).select("Date", F.col("Value").alias(signal), F.col("_place").alias(place), F.col("_n").alias(last))

        flat = rows.groupBy("Date").agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"_{c}") for c in ("Forecast", "Risk")])
        ranked = (rows.join(side("Forecast", "f", "_nf"), ["Date", "Forecast"], "left").join(side("Risk", "r", "_nr"), ["Date", "Risk"], "left")
                  .join(flat, "Date").withColumns({
                      "fc": F.when(F.col("_Forecast"), 0.0).otherwise(2.0 * (F.col("f") / F.col("_nf")) - 1.0),
                      "rc": F.when(F.col("_Risk"), 0.0).otherwise(2.0 * ((F.col("_nr") + 1.0 - F.col("r")) / F.col("_nr")) - 1.0)})
                  .drop("_nf", "_nr", "_Forecast", "_Risk").withColumn("_neg", F.lit(0.0)).select(*rows.columns, "f", "r", "_neg", "fc", "rc"))
    out = ranked.withColumn("action_buy_and_hold", F.lit(1))
    for arm, gate in (("gated", skill), ("ungated", 1.0)):
        # the fixed weights are added first, so a score that ties with a threshold rounds as w + (sentiment + risk) does
        score = fuse([(F.lit(cfg.risk), F.col("rc")), (F.lit(cfg.sentiment), F.lit(0.0)),
                      (F.lit(cfg.forecast * gate), F.col("fc"))])
        act = threshold_action(score, cfg.sell, cfg.buy)
        out = out.withColumn(f"action_{arm}", F.when(act == "BUY", 1).when(act == "SELL", -1).otherwise(0))
    return out.drop("f", "r", "fc", "rc", "_neg")


def recommendation_backtest(acted: DataFrame) -> DataFrame:
    """Per arm: hit rate over acted rows, calls, holds, buys and sells. One pass over the rows."""
    arms = ["buy_and_hold", "gated", "ungated"]
    long = acted.select("realised", F.explode(F.array(*[
        F.struct(F.lit(a).alias("Arm"), F.col(f"action_{a}").alias("act")) for a in arms])).alias("x")
    ).select("x.Arm", "x.act", "realised")
    correct = F.signum(F.col("act").cast("double")) == F.signum("realised")
    return long.groupBy("Arm").agg(
        F.avg(F.when(F.col("act") != 0, correct.cast("double"))).alias("hit_rate"),
        F.count_if(F.col("act") != 0).alias("n_calls"), F.count_if(F.col("act") == 0).alias("n_held"),
        F.count_if(F.col("act") == 1).alias("n_buys"), F.count_if(F.col("act") == -1).alias("n_sells"))


def signal_contribution(rows: DataFrame) -> DataFrame:
    """Per signal: share of sign agreement with the outcome and Pearson correlation."""
    out = F.signum("realised")
    one = rows.agg(F.array(*[
        F.struct(F.lit(n).alias("Signal"),
                 F.avg((F.signum(c) == out).cast("double")).alias("sign_agreement"),
                 corr(F.col(c), F.col("realised")).alias("corr_with_realised"))
        for n, c in (("forecast", "Forecast"), ("risk", "Risk"))]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def breadth_gauge(features: DataFrame, days: int = 7) -> DataFrame:
    """Mean daily return of the last days as a clipped score with a label, and the share of positive rows."""
    recent = recent_rows(features, days)
    score = clip(F.avg("Return_1d") * 100.0 * 25.0, -100.0, 100.0)
    return recent.agg(
        score.alias("Score"),
        (F.avg((F.coalesce(F.col("Return_1d") > 0, F.lit(False))).cast("double")) * 100.0).alias("Pct_Positive"),
        F.countDistinct("Ticker").alias("Names"),
    ).withColumn("Label", F.when(F.col("Score") > 20, "Bullish").when(F.col("Score") < -20, "Bearish").otherwise("Neutral"))


def first_last_return(panel: DataFrame) -> DataFrame:
    first, last = F.min_by("AdjClose", "Date"), F.max_by("AdjClose", "Date")
    return panel.groupBy("Ticker").agg(first.alias("first_price"), last.alias("last_price"),
                                       (div(last, first) - 1.0).alias("window_return"))


def rank_by_risk(features: DataFrame, group_bound: int | None = None) -> DataFrame:
    """Most and least volatile name at their last row and the median level."""
    last = features.groupBy("Ticker").agg(F.max_by("Vol_21d", "Date").alias("v")).where(F.col("v").isNotNull())
    median = quantiles(last, [], "v", {"m": 0.5}, group_bound).select("m").scalar()
    return last.agg(F.max_by("Ticker", F.struct("v", "Ticker")).alias("most_volatile"),
                    F.min_by("Ticker", F.struct("v", "Ticker")).alias("least_volatile"),
                    F.count("*").alias("names")).withColumn("median_vol", median)


def monthly_returns(panel: DataFrame) -> DataFrame:
    """(Year, Month, m): mean daily return of each series in the month, averaged over the series."""
    lp = F.ln("AdjClose")
    r = panel.select("Date", "Ticker", (lp - F.lag(lp).over(by_series())).alias("r"))
    per = r.groupBy(F.year("Date").alias("Year"), F.month("Date").alias("Month"), "Ticker").agg(F.avg("r").alias("m"))
    return per.groupBy("Year", "Month").agg(F.avg("m").alias("m"))


def seasonal_matrix(panel: DataFrame) -> DataFrame:
    """monthly_returns as a year x month matrix with fixed month columns."""
    wide = monthly_returns(panel).groupBy("Year").pivot("Month", list(range(1, 13))).agg(F.first("m"))
    return wide.select("Year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def seasonal_extremes(panel: DataFrame) -> DataFrame:
    """Best and worst calendar month by the mean of its yearly values."""
    by_month = monthly_returns(panel).groupBy("Month").agg(F.avg("m").alias("m"))
    return by_month.agg(F.max_by("Month", "m").alias("best_month"), F.min_by("Month", "m").alias("worst_month"))
