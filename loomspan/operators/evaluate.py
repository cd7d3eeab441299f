"""Forecast evaluation: error metrics, baselines, winner rules, rank skill and prediction bands."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.expr import corr, div
from loomspan.operators.ordering import previous
from loomspan.operators.ranking import WINDOW_BOUND, quantiles, rank_pct

ACTUAL, PREDICTED = "Actual_Return", "Predicted_Return"

# Names with a special role in the model table.
ENSEMBLE = "Ensemble (equal weight)"
BASELINE_FAMILY = "Baseline"


def enrich(predictions: DataFrame) -> DataFrame:
    y, p, price = F.col(ACTUAL), F.col(PREDICTED), F.col("AdjClose")
    return predictions.withColumns({
        "Residual": y - p, "Predicted_Price": price * F.exp(p), "Actual_Price": price * F.exp(y)})


def hit(y: Column, p: Column) -> Column:
    """1 where the signs agree, 0 where not, NULL for a zero actual."""
    return F.when(y != 0, (F.signum(y) == F.signum(p)).cast("double"))


def metric_columns(y: Column, p: Column, price: Column) -> list[Column]:
    e = y - p
    actual, forecast = price * F.exp(y), price * F.exp(p)
    return [
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg(F.abs(e)).alias("MAE"),
        (1.0 - div(F.sum(e * e), F.count("*") * F.var_pop(y))).alias("R2"),
        F.avg(hit(y, p)).alias("DirAcc"),
        F.count("*").alias("N"),
        (F.avg(F.when(F.abs(y) >= 1e-4, F.abs(e / F.nullif(y, F.lit(0.0))))) * 100.0).alias("MAPE_Return"),
        (F.avg(F.abs(div(actual - forecast, actual))) * 100.0).alias("MAPE"),
    ]


def regression_metrics(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("Model").agg(*metric_columns(F.col(ACTUAL), F.col(PREDICTED), F.col("AdjClose")))


def directional_accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("Model").agg(F.avg(hit(F.col(ACTUAL), F.col(PREDICTED))).alias("DirAcc"))


def outcomes(predictions: DataFrame) -> DataFrame:
    """One row per (Date, Ticker): the outcome all models share."""
    return predictions.groupBy("Date", "Ticker").agg(
        F.min(ACTUAL).alias(ACTUAL), F.min("AdjClose").alias("AdjClose"))


def naive_baseline(outcome: DataFrame) -> DataFrame:
    """Zero-return forecast; it makes no directional call, so its accuracy is NULL."""
    got = outcome.agg(*metric_columns(F.col(ACTUAL), F.lit(0.0), F.col("AdjClose")))
    return got.withColumn("DirAcc", F.lit(None).cast("double"))


def persistence_rows(outcome: DataFrame, per_ticker: bool = False, group_bound: int | None = None) -> DataFrame:
    """Previous row's actual as the forecast.

    By default "previous" is in (Date, Ticker) order, so the predecessor is usually another series of
    the same day. With a proven bound on the series per date, a window per date and a per-session table of
    last values suffice; without it the rows are range partitioned. per_ticker=True takes the previous row
    of the same series.
    """
    if per_ticker:
        w = Window.partitionBy("Ticker").orderBy("Date")
        return outcome.withColumn(PREDICTED, F.lag(ACTUAL).over(w)).where(F.col(PREDICTED).isNotNull())
    if group_bound is None or group_bound > WINDOW_BOUND:
        return previous(outcome, ["Date", "Ticker"], ACTUAL, PREDICTED).where(F.col(PREDICTED).isNotNull())
    ends = outcome.groupBy("Date").agg(F.max_by(ACTUAL, "Ticker").alias("_end"))
    carried = ends.select("Date", F.lag("_end").over(Window.partitionBy(F.lit(1)).orderBy("Date")).alias("_carry"))
    day = Window.partitionBy("Date").orderBy("Ticker")
    placed = outcome.withColumns({"_in": F.lag(ACTUAL).over(day), "_first": F.row_number().over(day) == 1})
    return (
        placed.join(F.broadcast(carried), "Date")
        .withColumn(PREDICTED, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in")))
        .where(F.col(PREDICTED).isNotNull()).drop("_in", "_first", "_carry")
    )


def persistence_accuracy(outcome: DataFrame, per_ticker: bool = False, group_bound: int | None = None) -> DataFrame:
    return persistence_rows(outcome, per_ticker, group_bound).agg(
        F.avg(hit(F.col(ACTUAL), F.col(PREDICTED))).alias("DirAcc_Persistence"), F.count("*").alias("N"))


def ensemble_mean(predictions: DataFrame, members: list[str]) -> DataFrame:
    """Equal-weight mean forecast of the members over rows that all members cover."""
    return (
        predictions.where(F.col("Model").isin(members))
        .groupBy("Date", "Ticker")
        .agg(F.avg(PREDICTED).alias(PREDICTED), F.min(ACTUAL).alias(ACTUAL), F.min("AdjClose").alias("AdjClose"),
             F.countDistinct("Model").alias("_m"))
        .where(F.col("_m") == len(members)).drop("_m")
        .withColumn("Model", F.lit(ENSEMBLE))
    )


def ensemble_convergence(metrics: DataFrame, members: list[str]) -> DataFrame:
    """One row: the ensemble converged only if every member did."""
    bad = metrics.where(F.col("Model").isin(members) & F.col("Converged").startswith("NO"))
    names = bad.agg(F.concat_ws(", ", F.array_sort(F.collect_list("Model"))).alias("b"))
    return names.select(F.lit(ENSEMBLE).alias("Model"), F.when(
        F.col("b") != "", F.concat(F.lit("NO - member(s) "), "b", F.lit(" did not converge"))
    ).otherwise("yes (average of converged members)").alias("Converged"))


def union_blocks(blocks: list[DataFrame]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def leaderboard(tables: list[DataFrame]) -> DataFrame:
    return union_blocks(tables).orderBy("MAE", "Model")


def top_models(board: DataFrame, n: int = 6) -> DataFrame:
    return board.orderBy("MAE", "Model").limit(n)


def model_mae(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("Model").agg(
        F.avg(F.abs(F.col(ACTUAL) - F.col(PREDICTED))).alias("MAE"))


def best_model(predictions: DataFrame) -> Column:
    """Name of the model with the lowest mean absolute error, as a scalar."""
    return model_mae(predictions).agg(F.min_by("Model", F.struct("MAE", "Model")).alias("m")).scalar()


def eligible_models(board: DataFrame) -> DataFrame:
    """Candidates: not the baseline, not the ensemble, and converged."""
    return board.where(
        (F.col("Family") != BASELINE_FAMILY) & (F.col("Model") != ENSEMBLE)
        & ~F.coalesce(F.col("Converged").startswith("NO"), F.lit(False)))


def best_and_runner_up(board: DataFrame) -> DataFrame:
    """The two lowest errors among eligible models (a table of one row per model)."""
    order = Window.partitionBy(F.lit(1)).orderBy("MAE", "Model")
    return eligible_models(board).withColumn("Place", F.row_number().over(order)).where("Place <= 2")


def declare_best(board: DataFrame) -> DataFrame:
    """One row: winner, runner-up, margin over the baseline in percent and what it beats."""
    base = board.where(F.col("Family") == BASELINE_FAMILY).agg(
        F.min("MAE").alias("b_mae"), F.min("DirAcc").alias("b_dir"))
    ranked = best_and_runner_up(board)

    def place(k: int, c: str) -> Column:
        return F.max(F.when(F.col("Place") == k, F.col(c)))

    got = ranked.agg(
        place(1, "Model").alias("Model"), place(1, "MAE").alias("MAE"), place(1, "DirAcc").alias("DirAcc"),
        place(2, "Model").alias("Runner_Up"), place(2, "MAE").alias("Runner_Up_MAE"))
    got = got.withColumns({"Baseline_MAE": base.select("b_mae").scalar(),
                           "Baseline_DirAcc": base.select("b_dir").scalar()})
    return got.select(
        F.when(F.col("Model").isNull(), "UNDECLARED").otherwise("DECLARED").alias("Status"), "*",
        (div(F.col("Baseline_MAE") - F.col("MAE"), F.col("Baseline_MAE")) * 100.0).alias("Margin_Pct"),
        F.coalesce(F.col("MAE") < F.col("Baseline_MAE"), F.lit(False)).alias("Beats_MAE"),
        F.coalesce(F.col("DirAcc") > F.col("Baseline_DirAcc"), F.lit(False)).alias("Beats_Dir"))


def honesty_check(board: DataFrame, baseline_mae: Column, baseline_dir: Column) -> DataFrame:
    """Best error and best accuracy of the converged models against the baseline; both must win."""
    got = board.where(~F.coalesce(F.col("Converged").startswith("NO"), F.lit(False))
                      & (F.col("Family") != BASELINE_FAMILY)).agg(
        F.min("MAE").alias("Best_MAE"), F.max("DirAcc").alias("Best_DirAcc"))
    got = got.withColumns({"Baseline_MAE": baseline_mae, "Baseline_DirAcc": baseline_dir})
    beats = (F.col("Best_MAE") < F.col("Baseline_MAE"), F.col("Best_DirAcc") > F.col("Baseline_DirAcc"))
    return got.withColumns({"Beats_MAE": beats[0], "Beats_Dir": beats[1], "Passes": beats[0] & beats[1]})


def rank_ic(predictions: DataFrame, group_bound: int | None = None) -> DataFrame:
    """Spearman correlation of forecast and outcome per (Model, Date), NULL for a flat day.

    `group_bound` bounds the names per date; without it both ranks use the ranged plan.
    """
    keys = ["Model", "Date"]
    ranked = rank_pct(predictions, keys, PREDICTED, "_p", group_bound)
    ranked = rank_pct(ranked, keys, ACTUAL, "_a", group_bound)
    flat = (F.max("_p") == F.min("_p")) | (F.max("_a") == F.min("_a"))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("Names"), F.when(~flat, corr(F.col("_p"), F.col("_a"))).alias("IC"))


def rank_ic_summary(ic: DataFrame) -> DataFrame:
    """Mean over the defined days (NULL days do not poison it) and the number of flat days."""
    return ic.groupBy("Model").agg(
        F.avg("IC").alias("Mean_IC"), F.count("IC").alias("Days"),
        F.count_if(F.col("IC").isNull()).alias("Degenerate"))


def top1_hit(predictions: DataFrame) -> DataFrame:
    """Per (Model, Date): was the highest forecast the highest outcome? The first name wins ties."""

    def winner(c: str) -> Column:
        return F.min_by("Ticker", F.struct(-F.col(c), F.col("Ticker")))

    return predictions.groupBy("Model", "Date").agg(
        winner(PREDICTED).alias("Called"), winner(ACTUAL).alias("Best")
    ).withColumn("Hit", F.col("Called") == F.col("Best"))


@F.pandas_udf(T.DoubleType())
def binomial_p_value(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Two-sided exact binomial p-value: mass of all outcomes no more likely than the observed one."""
    out = []
    for kk, nn, pp in zip(k, n, p):
        i = np.arange(int(nn) + 1)
        lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(nn) + 1)))])
        logp = lf[-1] - lf[i] - lf[::-1] + i * math.log(pp) + (int(nn) - i) * math.log1p(-pp)
        out.append(min(1.0, float(np.exp(logp[logp <= logp[int(kk)] + 1e-7]).sum())))
    return pd.Series(out)


def binom_test(hits: DataFrame, names: int, significance: float = 0.05) -> DataFrame:
    """Top-1 hits per model against chance 1/names; the test runs on one count row per model."""
    counts = hits.groupBy("Model").agg(F.count_if("Hit").alias("k"), F.count("*").alias("n"))
    return counts.withColumn("p_value", binomial_p_value(F.col("k"), F.col("n"), F.lit(1.0 / names))).withColumn(
        "significant", F.col("p_value") < significance)


def noskill_baseline(folds: DataFrame) -> DataFrame:
    """Mean absolute label per validation fold: the error of forecasting zero on the same rows."""
    return folds.where(F.col("Role") == "validate").groupBy("Fold").agg(
        F.avg(F.abs("Relative_Target")).alias("MAE_Relative"),
        F.avg(F.abs("Rank_Target")).alias("MAE_Rank"), F.count("*").alias("N"))


def forecast_band(predictions: DataFrame, z: float = 1.96, min_residuals: int = 20) -> DataFrame:
    """Price band from empirical residual quantiles per (Ticker, Model) and its realised coverage.

    z reads as a coverage probability. The groups are single series, bounded by the calendar.
    """
    coverage = 0.95 if z < 1.5 else min(0.995, max(0.5, math.erf(z / math.sqrt(2.0))))
    tail = (1.0 - coverage) / 2.0
    rows = enrich(predictions)
    keys = ["Ticker", "Model"]
    q = rows.groupBy(*keys).agg(F.percentile("Residual", [tail, 1.0 - tail]).alias("_q"), F.count("*").alias("_n"))
    band = q.where(F.col("_n") >= min_residuals).select(*keys, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
    inside = F.col("Actual_Price").between(F.col("Predicted_Price") * F.exp("lo"), F.col("Predicted_Price") * F.exp("hi"))
    return rows.join(band, keys).groupBy(*keys).agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.avg(inside.cast("double")).alias("coverage"),
        F.count("*").alias("n"))


def absolute_from_relative(rows: DataFrame) -> DataFrame:
    """Add the day mean of the label back to a relative forecast and score its direction."""
    means = rows.groupBy("Date").agg(F.avg("Target").alias("_mean"))
    p = F.col(PREDICTED) + F.col("_mean")
    return rows.join(F.broadcast(means), "Date").groupBy("Model").agg(
        F.avg(hit(F.col("Target"), p)).alias("DirAcc"), F.count("*").alias("N"))


def residual_quantiles(predictions: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles of the pooled residuals per model; a model's rows are unbounded, so the ranged plan is used."""
    return quantiles(enrich(predictions), ["Model"], "Residual", probs)
