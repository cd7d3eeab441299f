"""Registered queries: forecast evaluation, portfolio risk, signals and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import checks, evaluate, features, labels, models, portfolio, ranking, signals, stats
from loomspan.plans.cleaning_plans import KEYS
from loomspan.plans.feature_plans import ASSETS, CFG, FOLD_SQL, WIDE_SQL, model_table, rank_sql, wide
from loomspan.plans.registry import (BAR_SENTIMENT, BARS, CALM, CALM_PREDICTIONS, PREDICTIONS, SERIES, WEIGHTS, WIDE_BARS, WIDE_PREDICTIONS, g, gcols,
                                     lag, over0, publish, query, roll)
from loomspan.session import materialise
from loomspan.sources import fixtures as fx

LP = "ln(AdjClose)"
METRICS = ["RMSE", "MAE", "R2", "DirAcc", "MAPE_Return", "MAPE"]


def metric_sql(y: str, p: str) -> str:
    e = f"({y} - {p})"
    return f"""sqrt(avg({e} * {e})) AS RMSE, avg(abs({e})) AS MAE, 1 - sum({e} * {e}) / (count(*) * var_pop({y})) AS R2,
 avg(CASE WHEN {y} <> 0 THEN CASE WHEN sign({y}) = sign({p}) THEN 1e0 ELSE 0e0 END END) AS DirAcc, count(*) AS N,
 avg(CASE WHEN abs({y}) >= 1e-4 THEN abs({e} / {y}) END) * 100 AS MAPE_Return,
 avg(abs((AdjClose * exp({y}) - AdjClose * exp({p})) / (AdjClose * exp({y})))) * 100 AS MAPE"""


METRIC_SQL = f"WITH {PREDICTIONS}, mt AS (SELECT Model, {metric_sql('Actual_Return', 'Predicted_Return')} FROM fx_pred GROUP BY Model)"
OUT_SQL = f"oc AS (SELECT Date, Ticker, min(Actual_Return) AS y, min(AdjClose) AS AdjClose FROM fx_pred GROUP BY 1, 2)"
ENS_SQL = """en AS (SELECT Date, Ticker, avg(Predicted_Return) AS p, min(Actual_Return) AS y, min(AdjClose) AS AdjClose FROM fx_pred
 WHERE Model IN ('mom', 'rev') GROUP BY 1, 2 HAVING count(DISTINCT Model) = 2)"""
BOARD_SQL = METRIC_SQL + f""", {OUT_SQL}, {ENS_SQL}, board AS (
 SELECT *, 'ML' AS Family, CASE WHEN Model = 'zero' THEN 'NO - iteration cap' ELSE 'yes' END AS Converged FROM mt
 UNION ALL SELECT 'Naive random walk', RMSE, MAE, R2, NULL, N, MAPE_Return, MAPE, 'Baseline', 'yes' FROM (SELECT {metric_sql('y', '0e0')} FROM oc)
 UNION ALL SELECT 'Ensemble (equal weight)', *, 'ML', 'yes (average of converged members)' FROM (SELECT {metric_sql('y', 'p')} FROM en))"""


def board(spark, sf):
    """Model table: three models (one not converged), the zero-return baseline and the ensemble."""
    p = fx.predictions(spark, sf)
    metrics = evaluate.regression_metrics(p).withColumns({
        "Family": F.lit("ML"), "Converged": F.when(F.col("Model") == "zero", "NO - iteration cap").otherwise("yes")})
    base = evaluate.naive_baseline(evaluate.outcomes(p)).withColumns({
        "Model": F.lit("Naive random walk"), "Family": F.lit(evaluate.BASELINE_FAMILY), "Converged": F.lit("yes")})
    members = ["mom", "rev"]
    ens = evaluate.regression_metrics(evaluate.ensemble_mean(p, members)).withColumn("Family", F.lit("ML")).join(
        evaluate.ensemble_convergence(metrics, members), "Model")
    return evaluate.leaderboard([metrics, base, ens])


BOARD_KEYS = ["Model", "Family", "Converged", "N"]


@query("regression_metrics", METRIC_SQL + f" SELECT Model, N, {gcols(METRICS)} FROM mt")
def _(spark, sf):
    return publish(evaluate.regression_metrics(fx.predictions(spark, sf)), ["Model", "N"], METRICS)


@query("directional_accuracy", METRIC_SQL + f" SELECT Model, {g('DirAcc')} AS DirAcc FROM mt")
def _(spark, sf):
    return publish(evaluate.directional_accuracy(fx.predictions(spark, sf)), ["Model"], ["DirAcc"])


@query("naive_baseline", f"WITH {PREDICTIONS}, {OUT_SQL}, b AS (SELECT {metric_sql('y', '0e0')} FROM oc) SELECT N, {gcols(['RMSE', 'MAE', 'R2', 'MAPE_Return', 'MAPE'])}, CAST(NULL AS DOUBLE) AS DirAcc FROM b")
def _(spark, sf):
    return publish(evaluate.naive_baseline(evaluate.outcomes(fx.predictions(spark, sf))), ["N"], METRICS)


@query("persistence", f"WITH {PREDICTIONS}, {OUT_SQL}, l AS (SELECT Date, Ticker, y, lag(y) OVER (ORDER BY Date, Ticker) AS p FROM oc) SELECT Date, Ticker, {g('y')} AS Actual_Return, {g('p')} AS Predicted_Return FROM l WHERE p IS NOT NULL")
def _(spark, sf):
    return publish(evaluate.persistence_rows(evaluate.outcomes(fx.predictions(spark, sf)), group_bound=6), KEYS, ["Actual_Return", "Predicted_Return"])


PERSIST_SQL = """SELECT {v} AS DirAcc_Persistence, count(*) AS N FROM (SELECT y, lag(y) OVER ({o}) AS p FROM oc) WHERE p IS NOT NULL"""
HIT_SQL = g("avg(CASE WHEN y <> 0 THEN CASE WHEN sign(y) = sign(p) THEN 1e0 ELSE 0e0 END END)")


@query("persistence_accuracy", f"WITH {PREDICTIONS}, {OUT_SQL} " + PERSIST_SQL.format(v=HIT_SQL, o="ORDER BY Date, Ticker"))
def _(spark, sf):
    return publish(evaluate.persistence_accuracy(evaluate.outcomes(fx.predictions(spark, sf)), group_bound=6), ["N"], ["DirAcc_Persistence"])


@query("persistence_per_ticker", f"WITH {PREDICTIONS}, {OUT_SQL} " + PERSIST_SQL.format(v=HIT_SQL, o=SERIES))
def _(spark, sf):
    return publish(evaluate.persistence_accuracy(evaluate.outcomes(fx.predictions(spark, sf)), True), ["N"], ["DirAcc_Persistence"])


WIDE_PRED = f"""WITH {WIDE_BARS}, oc AS (SELECT * FROM (SELECT Date, Ticker, lead({LP}) OVER ({SERIES}) - {LP} AS y FROM fx_wide) WHERE y IS NOT NULL) """


@query("persistence_many", WIDE_PRED + PERSIST_SQL.format(v=HIT_SQL, o="ORDER BY Date, Ticker"))
def _(spark, sf):
    """The same rule over all supplier series; a date may hold any number of rows."""
    rows = signals.forward_outcome(fx.wide_bars(spark, sf)).where("realised is not null")
    out = rows.withColumn("Actual_Return", F.col("realised"))
    return publish(evaluate.persistence_accuracy(out), ["N"], ["DirAcc_Persistence"])


ENRICHED = ["Residual", "Predicted_Price", "Actual_Price"]


@query("prediction_enrich", f"""WITH {PREDICTIONS}, e AS (SELECT Date, Ticker, Model, Actual_Return - Predicted_Return AS Residual, AdjClose * exp(Predicted_Return) AS Predicted_Price,
 AdjClose * exp(Actual_Return) AS Actual_Price FROM fx_pred) SELECT Date, Ticker, Model, {gcols(ENRICHED)} FROM e""")
def _(spark, sf):
    return publish(evaluate.enrich(fx.predictions(spark, sf)), [*KEYS, "Model"], ENRICHED)


@query("ensemble_mean", f"WITH {PREDICTIONS}, {ENS_SQL} SELECT Date, Ticker, {g('p')} AS Predicted_Return FROM en")
def _(spark, sf):
    return publish(evaluate.ensemble_mean(fx.predictions(spark, sf), ["mom", "rev"]), KEYS, ["Predicted_Return"])


@query("union_predictions", f"WITH {PREDICTIONS}, {ENS_SQL} SELECT Model, Date, Ticker, {g('Predicted_Return')} AS Predicted_Return FROM fx_pred UNION ALL SELECT 'Ensemble (equal weight)', Date, Ticker, {g('p')} FROM en")
def _(spark, sf):
    p = fx.predictions(spark, sf)
    return publish(evaluate.union_blocks([p, evaluate.ensemble_mean(p, ["mom", "rev"])]), ["Model", *KEYS], ["Predicted_Return"])


@query("leaderboard", BOARD_SQL + f" SELECT Model, Family, Converged, N, {gcols(METRICS)} FROM board ORDER BY MAE")
def _(spark, sf):
    return publish(board(spark, sf), BOARD_KEYS, METRICS)


@query("topk_models", BOARD_SQL + f" SELECT Model, {g('MAE')} AS MAE FROM board ORDER BY board.MAE, Model LIMIT 6")
def _(spark, sf):
    return publish(evaluate.top_models(board(spark, sf), 6), ["Model"], ["MAE"])


@query("model_mae", f"WITH {PREDICTIONS} SELECT Model, {g('avg(abs(Actual_Return - Predicted_Return))')} AS MAE FROM fx_pred GROUP BY Model")
def _(spark, sf):
    return publish(evaluate.model_mae(fx.predictions(spark, sf)), ["Model"], ["MAE"])


ELIGIBLE = "el AS (SELECT * FROM board WHERE Family <> 'Baseline' AND Model <> 'Ensemble (equal weight)' AND Converged NOT LIKE 'NO%')"


@query("eligible_models", BOARD_SQL + f", {ELIGIBLE} SELECT Model, Converged FROM el")
def _(spark, sf):
    return evaluate.eligible_models(board(spark, sf)).select("Model", "Converged")


PLACES = "pl AS (SELECT *, row_number() OVER (ORDER BY MAE, Model) AS Place FROM el)"


@query("best_and_runner_up", BOARD_SQL + f", {ELIGIBLE}, {PLACES} SELECT Model, CAST(Place AS INTEGER) AS Place, {g('MAE')} AS MAE FROM pl WHERE Place <= 2")
def _(spark, sf):
    return publish(evaluate.best_and_runner_up(board(spark, sf)), ["Model", "Place"], ["MAE"])


@query("declare_best", BOARD_SQL + f""", {ELIGIBLE}, {PLACES}, b AS (SELECT min(MAE) AS bm, min(DirAcc) AS bd FROM board WHERE Family = 'Baseline'),
 w AS (SELECT max(CASE WHEN Place = 1 THEN Model END) AS Model, max(CASE WHEN Place = 1 THEN MAE END) AS MAE, max(CASE WHEN Place = 1 THEN DirAcc END) AS DirAcc,
  max(CASE WHEN Place = 2 THEN Model END) AS Runner_Up, max(CASE WHEN Place = 2 THEN MAE END) AS Runner_Up_MAE FROM pl)
 SELECT CASE WHEN Model IS NULL THEN 'UNDECLARED' ELSE 'DECLARED' END AS Status, Model, Runner_Up, {gcols(['MAE', 'DirAcc', 'Runner_Up_MAE'])}, {g('bm')} AS Baseline_MAE,
 {g('(bm - MAE) / bm * 100')} AS Margin_Pct, coalesce(MAE < bm, false) AS Beats_MAE, coalesce(DirAcc > bd, false) AS Beats_Dir FROM w, b""")
def _(spark, sf):
    return publish(evaluate.declare_best(board(spark, sf)), ["Status", "Model", "Runner_Up", "Beats_MAE", "Beats_Dir"],
                   ["MAE", "DirAcc", "Runner_Up_MAE", "Baseline_MAE", "Margin_Pct"])


@query("honesty_check", BOARD_SQL + f""", v AS (SELECT min(MAE) AS a, max(DirAcc) AS d FROM board WHERE Family <> 'Baseline' AND Converged NOT LIKE 'NO%'),
 b AS (SELECT min(MAE) AS bm FROM board WHERE Family = 'Baseline'),
 pd AS (SELECT avg(CASE WHEN y <> 0 THEN CASE WHEN sign(y) = sign(p) THEN 1e0 ELSE 0e0 END END) AS bd FROM (SELECT y, lag(y) OVER (ORDER BY Date, Ticker) AS p FROM oc) WHERE p IS NOT NULL)
 SELECT {g('a')} AS Best_MAE, {g('d')} AS Best_DirAcc, {g('bm')} AS Baseline_MAE, {g('bd')} AS Baseline_DirAcc, a < bm AS Beats_MAE, d > bd AS Beats_Dir, a < bm AND d > bd AS Passes FROM v, b, pd""")
def _(spark, sf):
    out = evaluate.outcomes(fx.predictions(spark, sf))
    mae = evaluate.naive_baseline(out).select("MAE").scalar()
    acc = evaluate.persistence_accuracy(out, group_bound=6).select("DirAcc_Persistence").scalar()
    return publish(evaluate.honesty_check(board(spark, sf), mae, acc), ["Beats_MAE", "Beats_Dir", "Passes"],
                   ["Best_MAE", "Best_DirAcc", "Baseline_MAE", "Baseline_DirAcc"])


IC_SQL = f"""WITH {PREDICTIONS}, p1 AS {rank_sql('Predicted_Return', 'Model, Date', 'fx_pred')}, p2 AS (SELECT Model, Date, Ticker, Actual_Return, pct AS pp FROM p1),
 p3 AS {rank_sql('Actual_Return', 'Model, Date', 'p2')},
 ic AS (SELECT Model, Date, count(*) AS Names, CASE WHEN max(pp) > min(pp) AND max(pct) > min(pct) THEN corr(pp, pct) END AS IC FROM p3 GROUP BY Model, Date)"""


@query("rank_ic", IC_SQL + f" SELECT Model, Date, Names, {g('IC')} AS IC FROM ic")
def _(spark, sf):
    return publish(evaluate.rank_ic(fx.predictions(spark, sf), group_bound=6), ["Model", "Date", "Names"], ["IC"])


@query("rank_ic_many", IC_SQL + f" SELECT Model, {g('avg(IC)')} AS Mean_IC, count(IC) AS Days, count(*) - count(IC) AS Degenerate FROM ic GROUP BY Model")
def _(spark, sf):
    """The same skill without a bound on the names per date."""
    return publish(evaluate.rank_ic_summary(evaluate.rank_ic(fx.predictions(spark, sf))), ["Model", "Days", "Degenerate"], ["Mean_IC"])


TOP_SQL = f"""WITH {PREDICTIONS}, tp AS (SELECT Model, Date, first(Ticker ORDER BY Predicted_Return DESC, Ticker) AS Called,
 first(Ticker ORDER BY Actual_Return DESC, Ticker) AS Best FROM fx_pred GROUP BY Model, Date)"""


@query("top1_hit", TOP_SQL + " SELECT Model, Date, Called, Best, Called = Best AS Hit FROM tp")
def _(spark, sf):
    return evaluate.top1_hit(fx.predictions(spark, sf))


@query("binom_test", TOP_SQL + f""", c AS (SELECT Model, count(CASE WHEN Called = Best THEN 1 END) AS k, count(*) AS n FROM tp GROUP BY Model),
 pm AS (SELECT Model, k, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(1e0 / 6) + (n - i) * ln(5e0 / 6) AS lp FROM c, (SELECT unnest(range(1000001)) AS i) WHERE i <= n),
 ob AS (SELECT Model, lp AS olp FROM pm WHERE i = k),
 pv AS (SELECT pm.Model, k, n, least(1, sum(exp(lp))) AS p_value FROM pm JOIN ob ON ob.Model = pm.Model WHERE lp <= olp + 1e-7 GROUP BY 1, 2, 3)
 SELECT Model, k, n, {g('p_value')} AS p_value, p_value < 5e-2 AS significant FROM pv""")
def _(spark, sf):
    return publish(evaluate.binom_test(evaluate.top1_hit(fx.predictions(spark, sf)), 6), ["Model", "k", "n", "significant"], ["p_value"])


@query("noskill_baseline", FOLD_SQL + f""", d AS (SELECT *, Target - avg(Target) OVER (PARTITION BY Date) AS rel FROM t),
 r AS {rank_sql('Target', 'Date', 'd')}
 SELECT CAST(Fold AS INTEGER) AS Fold, {g('avg(abs(rel))')} AS MAE_Relative, {g('avg(abs(pct - 5e-1))')} AS MAE_Rank, count(*) AS N
 FROM ro JOIN r ON r.Date = ro.Date AND r.Ticker = ro.Ticker WHERE Role = 'validate' GROUP BY Fold""")
def _(spark, sf):
    rows = features.forward_target(fx.bars(spark, sf)).where(F.col("Target").isNotNull())
    out = evaluate.noskill_baseline(labels.walk_forward_folds(labels.daily_demean(rows, group_bound=6), group_bound=6))
    return publish(out, ["Fold", "N"], ["MAE_Relative", "MAE_Rank"])


@query("forecast_band", f"""WITH {PREDICTIONS}, e AS (SELECT *, Actual_Return - Predicted_Return AS res, AdjClose * exp(Predicted_Return) AS pp, AdjClose * exp(Actual_Return) AS ap FROM fx_pred),
 q AS (SELECT Ticker, Model, quantile_cont(res, 2499789514822e-14) AS lo, quantile_cont(res, 1 - 2499789514822e-14) AS hi FROM e GROUP BY 1, 2 HAVING count(*) >= 20)
 SELECT e.Ticker, e.Model, {g('max(lo)', 4)} AS lo, {g('max(hi)', 4)} AS hi, {g('avg(CASE WHEN ap BETWEEN pp * exp(lo) AND pp * exp(hi) THEN 1e0 ELSE 0e0 END)')} AS coverage, count(*) AS n
 FROM e JOIN q ON q.Ticker = e.Ticker AND q.Model = e.Model GROUP BY 1, 2""")
def _(spark, sf):
    out = evaluate.forecast_band(fx.predictions(spark, sf))
    return publish(out, ["Ticker", "Model", "n"], ["lo", "hi", "coverage"], {"lo": 4, "hi": 4})


@query("absolute_from_relative", f"""WITH {PREDICTIONS}, m AS (SELECT *, avg(Actual_Return) OVER (PARTITION BY Model, Date) + Predicted_Return AS ab FROM fx_pred)
 SELECT Model, {g('avg(CASE WHEN Actual_Return <> 0 THEN CASE WHEN sign(Actual_Return) = sign(ab) THEN 1e0 ELSE 0e0 END END)')} AS DirAcc, count(*) AS N FROM m GROUP BY Model""")
def _(spark, sf):
    rows = fx.predictions(spark, sf).withColumn("Target", F.col("Actual_Return"))
    return publish(evaluate.absolute_from_relative(rows), ["Model", "N"], ["DirAcc"])


# portfolio ------------------------------------------------------------------------------------------------

PF = CFG.portfolio
SPLIT_WR = "ws AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY Date DESC) <= 252 THEN 'oos' ELSE 'est' END AS Part FROM wr)"
EST = "est AS (SELECT * FROM ws WHERE Part = 'est')"
HIST = "hist AS (" + " UNION ALL ".join(f"SELECT '{a}' AS Ticker, avg({a}) * 252 AS mu FROM {{src}}" for a in ASSETS) + ")"


def est(spark, sf):
    return portfolio.window_split(wide(spark, sf)).where("Part = 'est'").drop("Part")


@query("window_split_oos", WIDE_SQL + f", {SPLIT_WR} SELECT Date, Part FROM ws")
def _(spark, sf):
    return portfolio.window_split(wide(spark, sf)).select("Date", "Part")


@query("historical_mu", WIDE_SQL + f", {SPLIT_WR}, {EST}, {HIST.format(src='est')} SELECT Ticker, {g('mu')} AS mu FROM hist")
def _(spark, sf):
    return publish(portfolio.historical_mu(est(spark, sf), ASSETS), ["Ticker"], ["mu"])


MODEL_MU = """mm AS (SELECT Ticker, (exp(avg(Predicted_Return) * 21) - 1) * 12 AS mu FROM fx_pred WHERE Model = 'rev' AND Date >= (SELECT max(Date) FROM fx_pred) - 45 GROUP BY Ticker)"""


def model_mu(spark, sf):
    return portfolio.model_mu(fx.calm_predictions(spark, sf).where("Model = 'rev'"), PF)


@query("model_mu", f"WITH {CALM_PREDICTIONS}, {MODEL_MU} SELECT Ticker, {g('mu')} AS mu FROM mm")
def _(spark, sf):
    return publish(model_mu(spark, sf), ["Ticker"], ["mu"])


BLEND = "bl AS (SELECT hist.Ticker, coalesce(5e-1 * hist.mu + 5e-1 * mm.mu, hist.mu) AS mu FROM hist LEFT JOIN mm ON mm.Ticker = hist.Ticker)"
BLEND_SQL = WIDE_SQL.replace(f"WITH {CALM}", f"WITH {CALM_PREDICTIONS}") + f", {SPLIT_WR}, {EST}, {HIST.format(src='est')}, {MODEL_MU}, {BLEND}"


def blended(spark, sf):
    return portfolio.blended_mu(portfolio.historical_mu(est(spark, sf), ASSETS), model_mu(spark, sf), PF.model_weight)


@query("blended_mu", BLEND_SQL + f" SELECT Ticker, {g('mu')} AS mu FROM bl")
def _(spark, sf):
    return publish(blended(spark, sf), ["Ticker"], ["mu"])


@query("blend_join", f"""WITH {CALM_PREDICTIONS}, {MODEL_MU}, hs AS (SELECT Ticker, avg(r) * 252 AS mu FROM (SELECT Ticker, {LP} - {lag(LP)} AS r FROM fx_calm) GROUP BY Ticker),
 ms AS (SELECT * FROM mm WHERE Ticker IN ('AF', 'AO', 'NF', 'RF'))
 SELECT hs.Ticker, {g('coalesce(5e-1 * hs.mu + 5e-1 * ms.mu, hs.mu)')} AS mu FROM hs LEFT JOIN ms ON ms.Ticker = hs.Ticker""")
def _(spark, sf):
    hist = stats.log_returns(fx.calm_bars(spark, sf)).groupBy("Ticker").agg((F.avg("r") * 252).alias("mu"))
    model = model_mu(spark, sf).where(F.col("Ticker").isin(ASSETS))
    return publish(portfolio.blended_mu(hist, model, 0.5), ["Ticker"], ["mu"])


UPPER = [(a, b) for i, a in enumerate(ASSETS) for b in ASSETS[i:]]
LW = ("ce AS (SELECT " + ", ".join(f"{a} - avg({a}) OVER () AS {a}" for a in ASSETS) + " FROM est), pr AS ("
      + " UNION ALL ".join(f"SELECT '{a}' AS asset_i, '{b}' AS asset_j, {1 if a == b else 2} AS k, avg({a} * {b}) AS scov, sum({a} * {a} * {b} * {b}) AS q, count(*) AS n FROM ce" for a, b in UPPER)
      + """), tt AS (SELECT sum(k * scov * scov) AS s2, sum(k * q) AS q, sum(CASE WHEN k = 1 THEN scov END) AS tr, max(n) AS n, 4e0 AS p FROM pr),
 de AS (SELECT *, tr / p AS mu, (s2 - 2 * (tr / p) * tr + p * (tr / p) * (tr / p)) / p AS delta FROM tt),
 sh AS (SELECT mu, coalesce(least((q / n - s2) / (n * p), delta) / nullif(delta, 0), 0) AS sk FROM de),
 lw AS (SELECT asset_i, asset_j, k, ((1 - sk) * scov + CASE WHEN k = 1 THEN sk * mu ELSE 0 END) * 252 AS cov, sk AS shrinkage FROM pr, sh)""")


@query("ledoit_wolf", WIDE_SQL + f", {SPLIT_WR}, {EST}, {LW} SELECT asset_i, asset_j, {g('cov')} AS cov, {g('shrinkage')} AS shrinkage FROM lw")
def _(spark, sf):
    return publish(portfolio.ledoit_wolf(est(spark, sf), ASSETS), ["asset_i", "asset_j"], ["cov", "shrinkage"])


QUAD = """qd AS (SELECT (SELECT sum(w.Target_Weight * mu) FROM fx_weights w JOIN hist ON hist.Ticker = w.Ticker) AS expected_return,
 (SELECT sum(k * a.Target_Weight * b.Target_Weight * cov) FROM lw JOIN fx_weights a ON a.Ticker = asset_i JOIN fx_weights b ON b.Ticker = asset_j) AS variance)"""


@query("portfolio_quadratic", WIDE_SQL + f", {SPLIT_WR}, {EST}, {HIST.format(src='est')}, {LW}, {WEIGHTS}, {QUAD} SELECT {gcols(['expected_return', 'variance'])}, {g('sqrt(variance)')} AS volatility FROM qd")
def _(spark, sf):
    e = est(spark, sf)
    w = fx.weights(spark).select("Ticker", F.col("Target_Weight").alias("w"))
    return publish(portfolio.quadratic(w, portfolio.historical_mu(e, ASSETS), portfolio.ledoit_wolf(e, ASSETS)), [],
                   ["expected_return", "variance", "volatility"])


CAND = """cr AS (SELECT c, list_transform(range(4), lambda k: CAST(CAST('0x' || substr(md5('42:' || c || ':' || k), 1, 8) AS BIGINT) + 1 AS DOUBLE)) AS w FROM range(20000) t(c)),
 cs AS (SELECT c, list_transform(w, lambda x: x / list_sum(w)) AS w FROM cr),
 ci AS (SELECT c, 0 AS it, w FROM cs UNION ALL
  SELECT c, it + 1, list_transform(w, lambda x: CASE WHEN x >= 4e-1 THEN 4e-1 ELSE x * (1 - 4e-1 * len(list_filter(w, lambda y: y >= 4e-1))) / list_sum(list_filter(w, lambda y: y < 4e-1)) END)
  FROM ci WHERE it < 30 AND list_max(w) > 4e-1 + 1e-12),
 ca AS (SELECT c AS Candidate, arg_max(w, it) AS w FROM ci GROUP BY c)"""
SCORED = """cu AS (SELECT Candidate, w, w[1] * a + w[2] * b + w[3] * c + w[4] * d AS ret FROM ca,
  (SELECT max(CASE WHEN Ticker = 'AF' THEN mu END) AS a, max(CASE WHEN Ticker = 'AO' THEN mu END) AS b, max(CASE WHEN Ticker = 'NF' THEN mu END) AS c, max(CASE WHEN Ticker = 'RF' THEN mu END) AS d FROM hist)),
 ix AS (SELECT k, cov, CAST(list_position(['AF','AO','NF','RF'], asset_i) AS INT) AS i, CAST(list_position(['AF','AO','NF','RF'], asset_j) AS INT) AS j FROM lw),
 cv AS (SELECT Candidate, sum(k * w[i] * w[j] * cov) AS variance FROM ca, ix GROUP BY Candidate),
 sc AS (SELECT cu.Candidate, w, ret, sqrt(variance) AS vol, (ret - 4e-2) / sqrt(variance) AS sharpe FROM cu JOIN cv ON cv.Candidate = cu.Candidate)"""
SEARCH_SQL = WIDE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f", {SPLIT_WR}, {EST}, {HIST.format(src='est')}, {LW}, {CAND}, {SCORED}"


def scored(spark, sf):
    """Candidates scored on the estimation window; the candidate rows are the work, moments come from the data."""
    e = est(spark, sf)
    return portfolio.score_candidates(portfolio.candidate_weights(spark, ASSETS, PF), ASSETS,
                                      portfolio.historical_mu(e, ASSETS), portfolio.ledoit_wolf(e, ASSETS), PF.risk_free)


W_COLS = [f"w_{a}" for a in ASSETS]


@query("weight_candidates", SEARCH_SQL + f" SELECT Candidate, {gcols(['ret', 'vol', 'sharpe'])}, " + ", ".join(f"{g(f'w[{i + 1}]')} AS w_{a}" for i, a in enumerate(ASSETS)) + " FROM sc")
def _(spark, sf):
    out = scored(spark, sf).select("*", *[F.col("w")[i].alias(f"w_{a}") for i, a in enumerate(ASSETS)])
    return publish(out, ["Candidate"], ["ret", "vol", "sharpe", *W_COLS])


@query("weight_search", SEARCH_SQL + f""", pk AS (SELECT 'max_sharpe' AS Goal, first(Candidate ORDER BY sharpe DESC, Candidate) AS c FROM sc UNION ALL SELECT 'min_variance', first(Candidate ORDER BY vol, Candidate) FROM sc)
 SELECT Goal, Candidate, {gcols(['ret', 'vol', 'sharpe'])}, """ + ", ".join(f"{g(f'w[{i + 1}]')} AS w_{a}" for i, a in enumerate(ASSETS)) + " FROM pk JOIN sc ON sc.Candidate = pk.c")
def _(spark, sf):
    return publish(portfolio.weight_search(scored(spark, sf), ASSETS), ["Goal", "Candidate"], ["ret", "vol", "sharpe", *W_COLS])


@query("argmax_sharpe", SEARCH_SQL + f" SELECT arg_max(Candidate, sharpe) AS Candidate, {g('max(sharpe)')} AS sharpe FROM sc")
def _(spark, sf):
    out = scored(spark, sf).agg(F.max_by("Candidate", F.when(F.col("sharpe").isNotNull(), F.struct("sharpe", -F.col("Candidate")))).alias("Candidate"), F.max("sharpe").alias("sharpe"))
    return publish(out, ["Candidate"], ["sharpe"])


@query("efficient_frontier", SEARCH_SQL + f""", tg AS (SELECT i, 2e-2 + i * 55e-4 AS t FROM range(60) r(i)),
 fr AS (SELECT t, max(ret) AS ret, arg_max(vol, ret) AS vol FROM tg JOIN sc ON vol * vol <= t + 1e-12 GROUP BY t)
 SELECT {g('t')} AS Target_Variance, {g('vol')} AS Volatility, {g('ret')} AS Return, {g('ret / vol')} AS Sharpe FROM fr""")
def _(spark, sf):
    return publish(portfolio.frontier(scored(spark, sf), PF), [], ["Target_Variance", "Volatility", "Return", "Sharpe"])


@query("simplex_guard", f"""WITH {WIDE_BARS}, v AS (SELECT Ticker, sum(Close * Volume) AS v FROM fx_wide GROUP BY Ticker), x AS (SELECT v / (SELECT sum(v) FROM v) AS w FROM v)
 SELECT {g('sum(w)', 4)} AS total, {g('min(w)')} AS lowest, {g('max(w)')} AS highest, abs(sum(w) - 1) <= 1e-6 AND min(w) >= -1e-6 AND max(w) <= 2e-1 + 1e-6 AS valid FROM x""")
def _(spark, sf):
    """Traded value shares of all series, held to the weight cap."""
    traded = fx.wide_bars(spark, sf).groupBy("Ticker").agg(F.sum(F.col("Close") * F.col("Volume")).alias("v"))
    out = checks.simplex_guard(portfolio.normalised_weights(traded, "v"), "w", 0.2)
    return publish(out, ["valid"], ["total", "lowest", "highest"], {"total": 4})


BT = f"""{SPLIT_WR}, oos AS (SELECT * FROM ws WHERE Part = 'oos'),
 bt AS (SELECT 'optimised' AS Strategy, Date, 4e-1 * AF + 3e-1 * AO + 2e-1 * NF + 1e-1 * RF AS r FROM oos
  UNION ALL SELECT 'equal_weight', Date, (AF + AO + NF + RF) / 4 FROM oos UNION ALL SELECT 'benchmark_buy_hold', Date, NOB FROM oos)"""
BT_SQL = WIDE_SQL + f", {BT}"


def strategies(spark, sf):
    oos = portfolio.window_split(wide(spark, sf)).where("Part = 'oos'")
    w = fx.weights(spark).select("Ticker", F.col("Target_Weight").alias("w"))
    return portfolio.strategy_returns(portfolio.melt_assets(oos, ASSETS), w, oos.select("Date", F.col(CFG.benchmark).alias("r")))


@query("weights_join", WIDE_SQL + f" SELECT Date, {g('4e-1 * AF + 3e-1 * AO + 2e-1 * NF + 1e-1 * RF')} AS r FROM wr")
def _(spark, sf):
    w = fx.weights(spark).select("Ticker", F.col("Target_Weight").alias("w"))
    out = portfolio.strategy_returns(portfolio.melt_assets(wide(spark, sf), ASSETS), w).where("Strategy = 'optimised'")
    return publish(out, ["Date"], ["r"])


@query("backtest", BT_SQL + f" SELECT Strategy, Date, {g('r')} AS r FROM bt")
def _(spark, sf):
    return publish(strategies(spark, sf), ["Strategy", "Date"], ["r"])


@query("benchmark_align", BT_SQL + f" SELECT s.Date, {g('s.r')} AS strategy, {g('b.r')} AS benchmark FROM bt s JOIN bt b ON b.Date = s.Date WHERE s.Strategy = 'optimised' AND b.Strategy = 'benchmark_buy_hold'")
def _(spark, sf):
    s = strategies(spark, sf)
    a = s.where("Strategy = 'optimised'").select("Date", F.col("r").alias("strategy"))
    b = s.where("Strategy = 'benchmark_buy_hold'").select("Date", F.col("r").alias("benchmark"))
    return publish(a.join(b, "Date"), ["Date"], ["strategy", "benchmark"])


CURVE = """cu AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS v FROM bt WINDOW w AS (PARTITION BY Strategy ORDER BY Date ROWS UNBOUNDED PRECEDING)),
 dr AS (SELECT *, v / max(v) OVER (PARTITION BY Strategy ORDER BY Date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cu)"""
SHARPE_X = "coalesce(avg(r - 4e-2 / 252) / nullif(stddev_samp(r - 4e-2 / 252), 0), 0) * sqrt(252)"
SORTINO_X = "coalesce(avg(r - 4e-2 / 252) / nullif(sqrt(avg(pow(least(r - 4e-2 / 252, 0), 2))), 0), 0) * sqrt(252)"
SCORES = {"total_return": "arg_max(v, Date) - 1", "annualised_return": "pow(arg_max(v, Date), 252e0 / count(*)) - 1",
          "annualised_volatility": "stddev_samp(r) * sqrt(252)", "sharpe": SHARPE_X, "sortino": SORTINO_X, "max_drawdown": "min(dd)",
          "calmar": "avg(r) * 252 / nullif(abs(min(dd)), 0)", "var_95": "quantile_cont(r, 5e-2)", "final_value": "arg_max(v, Date)"}


@query("score_strategy", BT_SQL + f", {CURVE} SELECT Strategy, " + ", ".join(f"{g(e)} AS {n}" for n, e in SCORES.items()) + " FROM dr GROUP BY Strategy")
def _(spark, sf):
    return publish(portfolio.score_strategy(strategies(spark, sf), "Strategy", PF.risk_free), ["Strategy"], list(SCORES))


@query("sharpe", BT_SQL + f" SELECT Strategy, {g(SHARPE_X)} AS sharpe, count(r) AS n FROM bt GROUP BY Strategy")
def _(spark, sf):
    return publish(portfolio.sharpe(strategies(spark, sf), "Strategy", PF.risk_free), ["Strategy", "n"], ["sharpe"])


@query("sortino", BT_SQL + f" SELECT Strategy, {g(SORTINO_X)} AS sortino, count(r) AS n FROM bt GROUP BY Strategy")
def _(spark, sf):
    return publish(portfolio.sortino(strategies(spark, sf), "Strategy", PF.risk_free), ["Strategy", "n"], ["sortino"])


@query("calmar", BT_SQL + f", {CURVE} SELECT Strategy, {g('min(dd)')} AS max_drawdown, {g(SCORES['calmar'])} AS calmar FROM dr GROUP BY Strategy")
def _(spark, sf):
    return publish(portfolio.calmar(strategies(spark, sf), "Strategy"), ["Strategy"], ["max_drawdown", "calmar"])


@query("portfolio_beta", BT_SQL + f" SELECT count(*) AS n, {g('regr_slope(s.r, b.r)')} AS beta FROM bt s JOIN bt b ON b.Date = s.Date WHERE s.Strategy = 'optimised' AND b.Strategy = 'benchmark_buy_hold'")
def _(spark, sf):
    return publish(portfolio.portfolio_beta(strategies(spark, sf), "optimised", "benchmark_buy_hold"), ["n"], ["beta"])


@query("block_bootstrap", WIDE_SQL + f""", se AS (SELECT row_number() OVER (ORDER BY Date) - 1 AS i, 4e-1 * AF + 3e-1 * AO + 2e-1 * NF + 1e-1 * RF AS r, count(*) OVER () AS n FROM wr),
 pk AS (SELECT b, j, CAST('0x' || substr(md5('42:' || b || ':' || j), 1, 8) AS BIGINT) % (n - 19) AS st FROM (SELECT max(n) AS n FROM se), range(1000) x(b), range(100000) y(j) WHERE j < n // 20),
 sm AS (SELECT b, r FROM pk JOIN se ON se.i >= st AND se.i < st + 20),
 sh AS (SELECT b, {SHARPE_X} AS s FROM sm GROUP BY b)
 SELECT {g('avg(s)')} AS mean, {g('stddev_samp(s)')} AS std_error, {g('quantile_cont(s, 25e-3)')} AS ci_low, {g('quantile_cont(s, 975e-3)')} AS ci_high, count(*) AS n_bootstraps,
 (SELECT {g(SHARPE_X)} FROM se) AS point_estimate FROM sh""")
def _(spark, sf):
    w = fx.weights(spark).select("Ticker", F.col("Target_Weight").alias("w"))
    series = portfolio.strategy_returns(portfolio.melt_assets(wide(spark, sf), ASSETS), w).where("Strategy = 'optimised'").select("Date", "r")
    return publish(portfolio.block_bootstrap(series, PF), ["n_bootstraps"], ["mean", "std_error", "ci_low", "ci_high", "point_estimate"])


# signals -----------------------------------------------------------------------------------------------------

UNIVERSE = "un AS (SELECT unnest(['AF', 'AO', 'NF', 'RF']) AS Ticker)"


@query("mean_forecast_signal", f"WITH {CALM_PREDICTIONS} SELECT Ticker, {g('avg(Predicted_Return) * 21')} AS Forecast FROM fx_pred WHERE Model = 'mom' AND Date >= (SELECT max(Date) FROM fx_pred) - 45 GROUP BY Ticker")
def _(spark, sf):
    return publish(signals.forecast_signal(fx.calm_predictions(spark, sf).where("Model = 'mom'"), PF), ["Ticker"], ["Forecast"])


@query("latest_sentiment", f"WITH {BARS}, {BAR_SENTIMENT} SELECT Ticker, {g('arg_max(Sentiment_FinBERT, Date)')} AS Sentiment FROM fx_sent GROUP BY Ticker")
def _(spark, sf):
    return publish(signals.latest_sentiment(fx.bar_sentiment(spark, sf)), ["Ticker"], ["Sentiment"])


VOL_CTE = f"vv AS (SELECT Date, Ticker, {roll('stddev_samp', 'r', 21)} * sqrt(252) AS Vol_21d FROM (SELECT *, {LP} - {lag(LP)} AS r FROM {{src}}))"


def _beta_sql() -> str:
    return """be AS (SELECT a.Ticker, covar_pop(a.r, m.r) / var_pop(m.r) AS beta FROM (SELECT * FROM rr WHERE r IS NOT NULL) a JOIN (SELECT * FROM rr WHERE Ticker = 'NO' AND r IS NOT NULL) m ON m.Date = a.Date
 WHERE a.Ticker <> 'NO' GROUP BY a.Ticker)"""


@query("risk_signal", f"""WITH {BARS}, {VOL_CTE.format(src='fx_bars')}, rr AS (SELECT Date, Ticker, {LP} - {lag(LP)} AS r FROM fx_bars), {_beta_sql()},
 la AS (SELECT Ticker, Vol_21d AS v, 1 AS one FROM vv WHERE Date = (SELECT max(Date) FROM vv)),
 rv AS {rank_sql('v', 'one', 'la')}, b1 AS (SELECT *, 1 AS one FROM be), rb AS {rank_sql('beta', 'one', 'b1')}
 SELECT rv.Ticker, {g('coalesce(CASE WHEN rb.pct IS NOT NULL THEN (rv.pct + rb.pct) / 2 ELSE rv.pct END, 5e-1)')} AS Risk FROM rv LEFT JOIN rb ON rb.Ticker = rv.Ticker""")
def _(spark, sf):
    p = fx.bars(spark, sf)
    feats = features.series_features(p, only=["rolling_vol"])
    betas = stats.beta_ols(stats.log_returns(p), CFG.benchmark)
    return publish(signals.risk_signal(feats, p.agg(F.max("Date").alias("d")).scalar(), betas, group_bound=6), ["Ticker"], ["Risk"])


@query("centre_rank", f"""WITH {BARS}, k AS {rank_sql('Close', 'Date', 'fx_bars')}, n AS (SELECT *, min(Close) OVER (PARTITION BY Date) = max(Close) OVER (PARTITION BY Date) AS flat FROM k)
 SELECT Date, Ticker, {g('2 * CASE WHEN flat THEN 5e-1 ELSE pct END - 1')} AS centred FROM n""")
def _(spark, sf):
    return publish(signals.centre_rank(fx.bars(spark, sf), "Close", "centred", 6, ["Date"]), KEYS, ["centred"])


@query("fuse_signals", f"""WITH {BARS}, {BAR_SENTIMENT}, k AS (SELECT b.Date, b.Ticker, b.Volume, Sentiment_FinBERT AS s FROM fx_bars b JOIN fx_sent ON fx_sent.Date = b.Date AND fx_sent.Ticker = b.Ticker)
 SELECT Date, Ticker, {g('(3e-1 * s + 2e-1 * (-Volume / 100)) / 5e-1')} AS score FROM k""")
def _(spark, sf):
    rows = fx.bars(spark, sf).join(fx.bar_sentiment(spark, sf), KEYS)
    score = signals.fuse([(F.lit(0.3), F.col("Sentiment_FinBERT")), (F.lit(0.2), -F.col("Volume") / 100.0)])
    return publish(rows.withColumn("score", score), KEYS, ["score"])


SKILL = "greatest(0, least(1, coalesce((avg(abs(Actual_Return)) - avg(abs(Actual_Return - Predicted_Return))) / nullif(avg(abs(Actual_Return)), 0), 0)))"


@query("skill_gate", f"WITH {CALM_PREDICTIONS} SELECT {g(SKILL)} AS skill FROM fx_pred")
def _(spark, sf):
    return publish(signals.skill_gate(fx.calm_predictions(spark, sf)), [], ["skill"])


def unit_sql(src: str, value: str, out: str, name: str) -> str:
    return f"""{name}_r AS {rank_sql(value, 'one', src)},
 {name} AS (SELECT * EXCLUDE (pct), CASE WHEN min({value}) OVER () = max({value}) OVER () THEN 5e-1 ELSE pct END AS {out} FROM {name}_r)"""


def _word(v: str, hi: str, lo: str, mid: str) -> str:
    return f"CASE WHEN {v} > 66e-2 THEN '{hi}' WHEN {v} < 33e-2 THEN '{lo}' ELSE '{mid}' END"


RATIONALE_X = f"""concat(CASE action WHEN 'BUY' THEN '{signals.LEADS["BUY"]}' WHEN 'SELL' THEN '{signals.LEADS["SELL"]}' ELSE '{signals.LEADS["HOLD"]}' END, ' forecast ',
 {_word('f', 'strong', 'weak', 'neutral')}, printf(' (%.2f)', f), '; sentiment ', {_word('s', 'positive', 'negative', 'neutral')}, printf(' (%.2f)', s), '; risk ',
 {_word('rk', 'high', 'low', 'moderate')}, printf(' (%.2f)', rk), '.', CASE WHEN wf <= 0 THEN '{signals.NO_EDGE}' ELSE '' END)"""
REC_SQL = f"""WITH {CALM_PREDICTIONS}, {BAR_SENTIMENT}, {WEIGHTS}, {UNIVERSE}, {VOL_CTE.format(src='fx_calm')},
 sk AS (SELECT {SKILL} AS skill FROM fx_pred), bm AS (SELECT arg_min(Model, e) AS m FROM (SELECT Model, avg(abs(Actual_Return - Predicted_Return)) AS e FROM fx_pred GROUP BY Model)),
 ow AS (SELECT * FROM fx_pred WHERE Model = (SELECT m FROM bm)), fo AS (SELECT Ticker, avg(Predicted_Return) * 21 AS x FROM ow WHERE Date >= (SELECT max(Date) FROM ow) - 45 GROUP BY Ticker),
 la AS (SELECT Ticker, Vol_21d AS v, 1 AS one FROM vv WHERE Date = (SELECT max(Date) FROM vv) AND Ticker IN ('AF', 'AO', 'NF', 'RF')), ri AS {rank_sql('v', 'one', 'la')},
 se AS (SELECT Ticker, arg_max(Sentiment_FinBERT, Date) AS x FROM fx_sent GROUP BY Ticker),
 u0 AS (SELECT un.Ticker, 1 AS one, coalesce(fo.x, 5e-1) AS fv, coalesce(se.x, 5e-1) AS sv, coalesce(ri.pct, 5e-1) AS rv FROM un LEFT JOIN fo ON fo.Ticker = un.Ticker LEFT JOIN se ON se.Ticker = un.Ticker LEFT JOIN ri ON ri.Ticker = un.Ticker),
 {unit_sql('u0', 'fv', 'f', 'u1')}, {unit_sql('u1', 'sv', 's', 'u2')}, {unit_sql('u2', 'rv', 'rk', 'u3')}, u4 AS (SELECT *, -rk AS nr FROM u3),
 {unit_sql('u4', 'f', 'f2', 'u5')}, {unit_sql('u5', 's', 's2', 'u6')}, {unit_sql('u6', 'nr', 'r2', 'u7')},
 u8 AS (SELECT *, 5e-1 * (SELECT skill FROM sk) AS wf FROM u7),
 u9 AS (SELECT *, (wf * (2 * f2 - 1) + 3e-1 * (2 * s2 - 1) + 2e-1 * (2 * r2 - 1)) / (wf + 5e-1) AS c FROM u8),
 rec AS (SELECT *, CASE WHEN c >= 15e-2 THEN 'BUY' WHEN c <= -15e-2 THEN 'SELL' ELSE 'HOLD' END AS action FROM u9)"""


def recs(spark, sf):
    p = fx.calm_bars(spark, sf).where(F.col("Ticker").isin(ASSETS))
    feats = features.series_features(p, only=["rolling_vol"])
    return signals.recommendations(fx.calm_predictions(spark, sf), feats, fx.bar_sentiment(spark, sf), fx.weights(spark), CFG)


@query("recommendations", REC_SQL + f""" SELECT rec.Ticker, action AS Recommendation, round_even(c, 4) AS Composite_Score, round_even(f, 4) AS Forecast_Signal, round_even(s, 4) AS Sentiment_Signal,
 round_even(rk, 4) AS Risk_Signal, round_even(Target_Weight, 4) AS Target_Weight, round_even(Current_Weight, 4) AS Current_Weight, round_even(Target_Weight - Current_Weight, 4) AS Drift,
 CASE WHEN Target_Weight - Current_Weight > 5e-2 THEN 'INCREASE' WHEN Target_Weight - Current_Weight < -5e-2 THEN 'REDUCE' ELSE 'MAINTAIN' END AS Rebalance,
 {RATIONALE_X} AS Rationale FROM rec JOIN fx_weights w ON w.Ticker = rec.Ticker""")
def _(spark, sf):
    return recs(spark, sf)


@query("value_bucket_text", REC_SQL + f" SELECT Ticker, {RATIONALE_X} AS Rationale FROM rec")
def _(spark, sf):
    return recs(spark, sf).select("Ticker", "Rationale")


@query("action_counts", REC_SQL + " SELECT action AS Recommendation, count(*) AS n FROM rec GROUP BY action")
def _(spark, sf):
    return signals.action_counts(recs(spark, sf))


@query("melt_signals", REC_SQL + f""", x AS (SELECT Ticker, 'Forecast_Signal' AS Component, round_even(f, 4) AS Normalised, 5e-1 AS Weight FROM rec
 UNION ALL SELECT Ticker, 'Sentiment_Signal', round_even(s, 4), 3e-1 FROM rec UNION ALL SELECT Ticker, 'Risk_Signal', round_even(rk, 4), 2e-1 FROM rec)
 SELECT Ticker, Component, {gcols(['Normalised', 'Weight'])}, {g("CASE WHEN Component = 'Risk_Signal' THEN -1 ELSE 1 END * Weight * Normalised")} AS Signed FROM x""")
def _(spark, sf):
    out = signals.melt_signals(recs(spark, sf), {"Forecast_Signal": 0.5, "Sentiment_Signal": 0.3, "Risk_Signal": 0.2})
    return publish(out, ["Ticker", "Component"], ["Normalised", "Weight", "Signed"])


@query("universe_default", f"WITH {BARS}, {BAR_SENTIMENT}, u AS (SELECT unnest(['AF', 'AO', 'NF', 'RF', 'ZZ']) AS Ticker), l AS (SELECT Ticker, arg_max(Sentiment_FinBERT, Date) AS x FROM fx_sent GROUP BY Ticker) SELECT u.Ticker, {g('coalesce(x, 5e-1)')} AS Sentiment FROM u LEFT JOIN l ON l.Ticker = u.Ticker")
def _(spark, sf):
    latest = signals.latest_sentiment(fx.bar_sentiment(spark, sf))
    return publish(signals.universe_default((*ASSETS, "ZZ"), latest, "Sentiment"), ["Ticker"], ["Sentiment"])


@query("rebalance_plan", f"""WITH {BARS}, v AS (SELECT Ticker, sum(Close * Volume) AS v FROM fx_bars WHERE Ticker IN ('AF', 'AO', 'NF', 'RF') GROUP BY Ticker), {WEIGHTS},
 x AS (SELECT v.Ticker, v.v / (SELECT sum(v) FROM v) AS cw, Target_Weight AS tw FROM v JOIN fx_weights w ON w.Ticker = v.Ticker)
 SELECT Ticker, round_even(cw, 4) AS Current_Weight, round_even(tw, 4) AS Target_Weight, round_even(tw - cw, 4) AS Drift,
 CASE WHEN abs(tw - cw) > 5e-2 THEN CASE WHEN tw > cw THEN 'INCREASE' ELSE 'REDUCE' END ELSE 'HOLD' END AS Action, abs(tw - cw) > 5e-2 AS Band_Breached FROM x""")
def _(spark, sf):
    """Current weights are the traded value shares of the universe."""
    traded = fx.bars(spark, sf).where(F.col("Ticker").isin(ASSETS)).groupBy("Ticker").agg(F.sum(F.col("Close") * F.col("Volume")).alias("v"))
    held = portfolio.normalised_weights(traded, "v").join(fx.weights(spark).select("Ticker", "Target_Weight"), "Ticker")
    return signals.rebalance_plan(held.withColumnRenamed("w", "Current_Weight"))


@query("forward_outcome", f"WITH {BARS} SELECT Date, Ticker, {g(f'lead({LP}) OVER ({SERIES}) - {LP}')} AS realised FROM fx_bars")
def _(spark, sf):
    return publish(signals.forward_outcome(fx.bars(spark, sf)), KEYS, ["realised"])


def risk_sql(src: str) -> str:
    return f"""q1 AS (SELECT Date, Ticker, AdjClose, {LP} - {lag(LP)} AS r FROM {src}),
 q2 AS (SELECT Date, Ticker, {roll('stddev_samp', 'r', 21)} AS sd, {over0('AdjClose', roll('avg', 'AdjClose', 50))} - 1 AS gap FROM q1),
 q3 AS (SELECT Date, Ticker, {roll('avg', 'sd', 63)} AS lvl, coalesce({roll('avg', 'gap', 10)}, 0) AS stretch FROM q2),
 q4 AS {rank_sql('lvl', 'Date', 'q3')}, rk AS (SELECT Date, Ticker, -(pct - 5e-1) * 2 - stretch * 4 AS Risk FROM q4)"""


@query("trailing_risk", f"WITH {BARS}, {risk_sql('fx_bars')} SELECT Date, Ticker, {g('Risk')} AS Risk FROM rk")
def _(spark, sf):
    return publish(signals.trailing_risk(fx.bars(spark, sf), group_bound=6), KEYS, ["Risk"])


@query("trailing_risk_many", f"WITH {WIDE_BARS}, {risk_sql('fx_wide')} SELECT Date, Ticker, {g('Risk')} AS Risk FROM rk")
def _(spark, sf):
    """The same signal over all supplier series, without a bound on the series per date."""
    return publish(signals.trailing_risk(fx.wide_bars(spark, sf)), KEYS, ["Risk"])


def outcome_sql(src: str) -> str:
    return f"""{risk_sql(src)}, fw AS (SELECT Date, Ticker, lead({LP}) OVER ({SERIES}) - {LP} AS realised FROM {src}),
 so AS (SELECT p.Date, p.Ticker, p.Predicted_Return AS Forecast, rk.Risk, fw.realised FROM fx_pred p JOIN rk ON rk.Date = p.Date AND rk.Ticker = p.Ticker
  JOIN fw ON fw.Date = p.Date AND fw.Ticker = p.Ticker WHERE Model = 'rev' AND Risk IS NOT NULL AND realised IS NOT NULL)"""


SO = outcome_sql("fx_bars")


def outcome_rows(spark, sf):
    p = fx.bars(spark, sf)
    return signals.signal_outcome(fx.predictions(spark, sf).where("Model = 'rev'"), signals.trailing_risk(p, group_bound=6), signals.forward_outcome(p))


@query("signal_outcome_join", f"WITH {PREDICTIONS}, {SO} SELECT Date, Ticker, {gcols(['Forecast', 'Risk', 'realised'])} FROM so")
def _(spark, sf):
    return publish(outcome_rows(spark, sf), KEYS, ["Forecast", "Risk", "realised"])


def day_unit(src: str, value: str, out: str, name: str) -> str:
    return f"""{name}_r AS {rank_sql(value, 'Date', src)},
 {name} AS (SELECT * EXCLUDE (pct), CASE WHEN min({value}) OVER (PARTITION BY Date) = max({value}) OVER (PARTITION BY Date) THEN 5e-1 ELSE pct END AS {out} FROM {name}_r)"""


def _act(w: str) -> str:
    score = f"({w} * (2 * f2 - 1) + 2e-1 * (2 * r2 - 1)) / ({w} + 5e-1)"
    return f"CASE WHEN {score} >= 15e-2 THEN 1 WHEN {score} <= -15e-2 THEN -1 ELSE 0 END"


ACT_SQL = f"""WITH {PREDICTIONS}, {SO}, {day_unit('so', 'Forecast', 'f', 'd1')}, {day_unit('d1', 'Risk', 'rr', 'd2')}, d3 AS (SELECT *, -rr AS nr FROM d2),
 {day_unit('d3', 'f', 'f2', 'd4')}, {day_unit('d4', 'nr', 'r2', 'd5')},
 act AS (SELECT *, 1 AS action_buy_and_hold, {_act('15e-2')} AS action_gated, {_act('5e-1')} AS action_ungated FROM d5)"""


def acted(spark, sf):
    return signals.backtest_actions(outcome_rows(spark, sf), CFG.recommend, 0.3, group_bound=6)


@query("backtest_actions", ACT_SQL + " SELECT Date, Ticker, action_buy_and_hold, CAST(action_gated AS INTEGER) AS action_gated, CAST(action_ungated AS INTEGER) AS action_ungated FROM act")
def _(spark, sf):
    return acted(spark, sf).select(*KEYS, "action_buy_and_hold", "action_gated", "action_ungated")


@query("backtest_actions_many", f"""WITH {WIDE_PREDICTIONS}, {outcome_sql('fx_wide')},
 n1 AS (SELECT *, (rank() OVER (PARTITION BY Date ORDER BY Forecast) + (count(*) OVER (PARTITION BY Date, Forecast) - 1) / 2e0) AS pf,
  (rank() OVER (PARTITION BY Date ORDER BY Risk) + (count(*) OVER (PARTITION BY Date, Risk) - 1) / 2e0) AS pr, count(*) OVER (PARTITION BY Date) AS n,
  min(Forecast) OVER (PARTITION BY Date) = max(Forecast) OVER (PARTITION BY Date) AS ff, min(Risk) OVER (PARTITION BY Date) = max(Risk) OVER (PARTITION BY Date) AS fr FROM so),
 n2 AS (SELECT *, CASE WHEN ff THEN 5e-1 ELSE pf / n END AS f2, CASE WHEN fr THEN 5e-1 ELSE (n + 1 - pr) / n END AS r2 FROM n1)
 SELECT Date, Ticker, 1 AS action_buy_and_hold, {_act('15e-2')} AS action_gated, {_act('5e-1')} AS action_ungated FROM n2""")
def _(spark, sf):
    """The same actions over all supplier series; the series per date are counted.

    The bars are written once. A bar takes its outcome and forecast along to the ranks of its date, so bars are moved twice,
    by series and by date, and not joined again.
    """
    p = materialise(fx.wide_bars(spark, sf).select(*KEYS, "AdjClose"), "action-bars", lean=True)
    bound = ranking.largest_group(p, ["Date"])
    outcome = signals.forward_outcome(p.repartition("Ticker"), keep=("AdjClose",))
    forecasts = fx.predictions_over(outcome, keep=("realised",), whole=True).where("Model = 'rev'")
    rows = signals.signal_outcome(signals.trailing_risk(forecasts, bound, keep=("Predicted_Return", "realised")))
    return signals.backtest_actions(rows, CFG.recommend, 0.3, bound).select(*KEYS, "action_buy_and_hold", "action_gated", "action_ungated")


@query("rec_backtest", ACT_SQL + f""", lo AS (SELECT 'buy_and_hold' AS Arm, action_buy_and_hold AS a, realised FROM act UNION ALL SELECT 'gated', action_gated, realised FROM act UNION ALL SELECT 'ungated', action_ungated, realised FROM act)
 SELECT Arm, {g('avg(CASE WHEN a <> 0 THEN CASE WHEN sign(a) = sign(realised) THEN 1e0 ELSE 0e0 END END)')} AS hit_rate, count(CASE WHEN a <> 0 THEN 1 END) AS n_calls,
 count(CASE WHEN a = 0 THEN 1 END) AS n_held, count(CASE WHEN a = 1 THEN 1 END) AS n_buys, count(CASE WHEN a = -1 THEN 1 END) AS n_sells FROM lo GROUP BY Arm""")
def _(spark, sf):
    return publish(signals.recommendation_backtest(acted(spark, sf)), ["Arm", "n_calls", "n_held", "n_buys", "n_sells"], ["hit_rate"])


@query("signal_contribution", f"WITH {PREDICTIONS}, {SO} " + " UNION ALL ".join(
    f"SELECT '{n}' AS Signal, {g(f'avg(CASE WHEN sign({c}) = sign(realised) THEN 1e0 ELSE 0e0 END)')} AS sign_agreement, {g(f'corr({c}, realised)')} AS corr_with_realised FROM so"
    for n, c in (("forecast", "Forecast"), ("risk", "Risk"))))
def _(spark, sf):
    return publish(signals.signal_contribution(outcome_rows(spark, sf)), ["Signal"], ["sign_agreement", "corr_with_realised"])


# model fitting ------------------------------------------------------------------------------------------------

RIDGE_GRID = {"alpha": [1.0, 10.0, 100.0, 1000.0, 10_000.0]}
MODEL_COLS = ["Return_1d", "Return_5d", "Price_to_SMA_20", "Vol_21d", "Volume_Z"]


def model_rows(spark, sf):
    panel = materialise(fx.bars(spark, sf), "model-bars")  # six series over the calendar; read for the split, the scales and the rows
    feats = features.series_features(panel, only=["log_returns", "sma", "rolling_vol", "volume_z"])
    rows = features.drop_missing(features.forward_target(feats), MODEL_COLS)
    return labels.with_split(rows).select(*KEYS, "AdjClose", "Split", *MODEL_COLS, "Target")


def _fitted(spark, sf, name, **params):
    """Fit on scaled train rows, score the test rows: one metrics row."""
    rows = materialise(models.standard_scale(model_rows(spark, sf), MODEL_COLS, F.col("Split") == "train"), "model-rows")
    model = models.FITTERS[name](rows.where("Split = 'train'"), MODEL_COLS, **params)
    scored_rows = models.predict(model, rows.where("Split = 'test'"), MODEL_COLS, name).withColumn("Actual_Return", F.col("Target"))
    return evaluate.regression_metrics(scored_rows)


def _normal_equations(rows: str, alphas: list[float], standard: str) -> str:
    """CTEs of the ridge solutions per (Fold, alpha) over the rows (Fold, i, Role, x LIST, y): w, in units of the columns.

    z holds the train rows centred and scaled, gm their products, and a recursion eliminates column after column.
    """
    p = len(MODEL_COLS)
    return f"""mom AS (SELECT Fold, j, avg(x[j]) AS mu, {standard} AS sd FROM {rows}, range(1, {p + 1}) t(j) WHERE Role = 'train' GROUP BY Fold, j),
 my AS (SELECT Fold, avg(y) AS my FROM {rows} WHERE Role = 'train' GROUP BY Fold),
 z AS (SELECT r.Fold, r.i, m.j, (x[m.j] - mu) / sd AS v, y - my AS yc FROM {rows} r JOIN mom m ON m.Fold = r.Fold JOIN my ON my.Fold = r.Fold WHERE Role = 'train'),
 gm AS (SELECT a.Fold, a.j, b.j AS k, sum(a.v * b.v) AS s FROM z a JOIN z b ON a.Fold = b.Fold AND a.i = b.i GROUP BY 1, 2, 3),
 gy AS (SELECT Fold, j, sum(v * yc) AS s FROM z GROUP BY Fold, j),
 rw AS (SELECT gm.Fold, alpha, gm.j, list_append(list(gm.s + CASE WHEN j = k THEN alpha ELSE 0 END ORDER BY k), any_value(gy.s)) AS r
  FROM gm JOIN gy USING (Fold, j), (VALUES {', '.join(f'({x}::DOUBLE)' for x in alphas)}) t(alpha) GROUP BY gm.Fold, alpha, gm.j),
 el AS (SELECT Fold, alpha, 1 AS k, list(r ORDER BY j) AS m FROM rw GROUP BY Fold, alpha
  UNION ALL SELECT Fold, alpha, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k])
   ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END) FROM el WHERE k <= {p}),
 w AS (SELECT el.Fold, alpha, list(m[j][{p + 1}] / sd ORDER BY j) AS w, any_value(my) - sum(m[j][{p + 1}] / sd * mu) AS b
  FROM el JOIN mom ON mom.Fold = el.Fold JOIN my ON my.Fold = el.Fold WHERE k = {p + 1} GROUP BY el.Fold, alpha)"""


MODEL_SQL = f"""WITH RECURSIVE {BARS}, f0 AS (SELECT *, {LP} - lag({LP}) OVER ({SERIES}) AS r1, {LP} - lag({LP}, 5) OVER ({SERIES}) AS r5,
  AdjClose / nullif({roll('avg', 'AdjClose', 20)}, 0) AS ps, (Volume - {roll('avg', 'Volume', 21)}) / nullif({roll('stddev_samp', 'Volume', 21)}, 0) AS vz,
  lead({LP}) OVER ({SERIES}) - {LP} AS y FROM fx_bars),
 f1 AS (SELECT *, {roll('stddev_samp', 'r1', 21)} * sqrt(252) AS vo FROM f0),
 f2 AS (SELECT Date, Ticker, AdjClose, [r1, r5, ps, vo, vz] AS x, y FROM f1 WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND ps IS NOT NULL AND vo IS NOT NULL AND vz IS NOT NULL AND y IS NOT NULL),
 dn AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS di, count(*) OVER () AS nd FROM (SELECT DISTINCT Date FROM f2)),
 ro AS (SELECT f2.*, CASE WHEN di < floor(nd * 7e-1) THEN 'train' WHEN di < floor(nd * 7e-1) + floor(nd * 15e-2) THEN 'val' ELSE 'test' END AS Split FROM f2 JOIN dn USING (Date)),"""


@query("ridge_fit", MODEL_SQL + f""" sc AS (SELECT avg(x[1]) AS m1, avg(x[2]) AS m2, avg(x[3]) AS m3, avg(x[4]) AS m4, avg(x[5]) AS m5,
  stddev_pop(x[1]) AS s1, stddev_pop(x[2]) AS s2, stddev_pop(x[3]) AS s3, stddev_pop(x[4]) AS s4, stddev_pop(x[5]) AS s5 FROM ro WHERE Split = 'train'),
 nr AS (SELECT 0 AS Fold, row_number() OVER () AS i, Split AS Role, AdjClose,
  [(x[1] - m1) / s1, (x[2] - m2) / s2, (x[3] - m3) / s3, (x[4] - m4) / s4, (x[5] - m5) / s5] AS x, y FROM ro, sc),
 {_normal_equations('nr', [1.0], '1e0')},
 pr AS (SELECT AdjClose, y, b + list_sum(list_transform(x, lambda v, j: v * w[j])) AS p FROM nr, w WHERE Role = 'test'),
 mt AS (SELECT {metric_sql('y', 'p')} FROM pr)
 SELECT 'Ridge' AS Model, N, {gcols(METRICS)} FROM mt""")
def _(spark, sf):
    return publish(_fitted(spark, sf, "Ridge", alpha=1.0), ["Model", "N"], METRICS)


@query("forest_fit")
def _(spark, sf):
    return _fitted(spark, sf, "RandomForest", trees=150, depth=6)


@query("gbt_fit")
def _(spark, sf):
    return _fitted(spark, sf, "GradientBoosting", rounds=200, depth=3)


@query("hist_gbt_fit")
def _(spark, sf):
    """400 rounds at most on seven tenths of the rows each; the error on the last dates of the train rows ends them."""
    return _fitted(spark, sf, "HistGradientBoosting", rounds=400, depth=5, subsample=0.7)


@query("walk_forward_search", MODEL_SQL + f""" tr AS (SELECT x, y, row_number() OVER (ORDER BY Date, Ticker) - 1 AS i, count(*) OVER () AS n FROM ro WHERE Split = 'train'),
 kk AS (SELECT *, greatest(2, least(5, greatest(2, n // 400))) AS k FROM tr), ts AS (SELECT *, greatest(500, n // (k + 2)) AS t FROM kk),
 fo AS (SELECT Fold, i, x, y, CASE WHEN i < n - (k - Fold) * t THEN 'train' WHEN i < n - (k - Fold) * t + t THEN 'validate' END AS Role FROM ts, range(5) q(Fold) WHERE Fold < k),
 nr AS (SELECT * FROM fo WHERE Role IS NOT NULL),
 {_normal_equations('nr', RIDGE_GRID['alpha'], 'stddev_pop(x[j])')},
 er AS (SELECT w.Fold, alpha, avg(abs(y - b - list_sum(list_transform(x, lambda v, j: v * w[j])))) AS mae FROM nr JOIN w ON w.Fold = nr.Fold WHERE Role = 'validate' GROUP BY w.Fold, alpha)
 SELECT alpha, {g('avg(mae)', 9)} AS mean_mae FROM er GROUP BY alpha""")
def _(spark, sf):
    rows = materialise(labels.walk_forward_folds(model_rows(spark, sf).where("Split = 'train'"), n_splits=5, group_bound=6), "folds")
    log = models.walk_forward_search(rows, MODEL_COLS, "Ridge", labels.parameter_grid(RIDGE_GRID))
    out = spark.createDataFrame([(e["params"]["alpha"], e["mean_mae"]) for e in log], "alpha double, mean_mae double")
    return publish(out, ["alpha"], ["mean_mae"], {"mean_mae": 9})


@query("ablation")
def _(spark, sf):
    rows = materialise(model_rows(spark, sf).join(fx.bar_sentiment(spark, sf), KEYS), "ablation-rows")
    return models.ablation(rows, MODEL_COLS, ["Sentiment_FinBERT"], name="HistGradientBoosting", rounds=300, rate=0.2, depth=3)


# from features to recommendations on fitted models ------------------------------------------------------------

SETTINGS = {
    "RandomForest": {"trees": 150, "depth": 6}, "GradientBoosting": {"rounds": 200, "depth": 3},
    "HistGradientBoosting": {"rounds": 400, "depth": 5, "subsample": 0.7},
}


MOST_MISSING = 0.1  # share of rows without a value, beyond which a column is left out of the models
_FITTED: dict[tuple[str, str], tuple] = {}


def fitted_forecasts(spark, sf):
    """fit_all, whose written tables serve both queries of a session."""
    key = spark.sparkContext.applicationId, sf
    if key not in _FITTED:
        _FITTED[key] = fit_all(spark, sf)
    return _FITTED[key]


def fit_all(spark, sf):
    """Test forecasts of every model over the whole feature table, and their leaderboard.

    Split -> redundant columns dropped -> ridge search over the folds -> fits on the train rows -> forecasts and their mean ->
    scores beside the zero forecast.
    """
    feats = materialise(model_table(spark, sf), "model-features")
    names = sorted(features.numeric_columns(feats))
    total = feats.count()
    sparse = {r["Column"] for r in features.null_report(feats, names).where(F.col("Nulls") > MOST_MISSING * total).collect()}
    names = [c for c in names if c not in sparse]
    rows = labels.with_split(features.drop_missing(feats, names))
    rows = materialise(rows.select(*KEYS, "AdjClose", "Split", *names, "Target"), "model-table")
    train = rows.where("Split = 'train'")
    columns = models.collinearity_filter(train, names)
    folds = materialise(labels.walk_forward_folds(train, n_splits=labels.feasible_folds(train.count()), group_bound=len(CFG.universe)), "model-folds")
    best = models.walk_forward_search(folds, columns, "Ridge", labels.parameter_grid(RIDGE_GRID))[0]["params"]
    scaled = materialise(models.standard_scale(rows, columns, F.col("Split") == "train"), "model-scaled")
    test = scaled.where("Split = 'test'")
    forecasts = []
    for name, params in ({"Ridge": best} | SETTINGS).items():
        model = models.FITTERS[name](scaled.where("Split = 'train'"), columns, **params)
        forecasts.append(models.predict(model, test, columns, name).select(*KEYS, "AdjClose", "Model", "Predicted_Return", F.col("Target").alias("Actual_Return")))
    every = materialise(evaluate.union_blocks(forecasts), "model-forecasts")
    members = ["Ridge", *SETTINGS]
    metrics = evaluate.regression_metrics(every).withColumns({"Family": F.lit("ML"), "Converged": F.lit("yes")})
    mean = evaluate.ensemble_mean(every, members).select(*every.columns)
    ensemble = evaluate.regression_metrics(mean).withColumns({"Family": F.lit("ML"), "Converged": F.lit("yes")})
    base = evaluate.naive_baseline(evaluate.outcomes(every)).withColumns({
        "Model": F.lit("Naive random walk"), "Family": F.lit(evaluate.BASELINE_FAMILY), "Converged": F.lit("yes")})
    return every.unionByName(mean), materialise(evaluate.leaderboard([metrics, base, ensemble]), "model-board")


@query("model_run")
def _(spark, sf):
    """Scores of every fitted model, their mean and the zero forecast on the test rows, best first."""
    return fitted_forecasts(spark, sf)[1]


@query("model_recommendations")
def _(spark, sf):
    """The run to its end: the declared model's forecasts give expected returns, these with shrunk covariances the weights, and
    forecasts, sentiment and risk the recommendations, each with the declared model and what it was declared by."""
    forecasts, table = fitted_forecasts(spark, sf)
    bars = materialise(fx.bars(spark, sf), "model-bars")
    panel = bars.where(F.col("Ticker").isin(ASSETS))
    declared = evaluate.declare_best(table).select("Status", F.col("Model").alias("Declared"), "Beats_MAE").head()
    own = forecasts.where(F.col("Model") == F.lit(declared["Declared"]))
    returns = stats.log_returns(panel)
    cut = forecasts.agg(F.min("Date")).head()[0]
    past = materialise(returns.where(F.col("Date") < F.lit(cut)).groupBy("Date").pivot("Ticker", ASSETS).agg(F.max("r")).dropna(), "model-returns")
    mu = portfolio.blended_mu(portfolio.historical_mu(past, ASSETS), portfolio.model_mu(own, PF), PF.model_weight)
    found = portfolio.weight_search(portfolio.score_candidates(portfolio.candidate_weights(spark, ASSETS, PF), ASSETS, mu, portfolio.ledoit_wolf(past, ASSETS), PF.risk_free), ASSETS)
    weights = found.where("Goal = 'max_sharpe'").unpivot([], [f"w_{a}" for a in ASSETS], "Ticker", "Target_Weight").select(
        F.substring("Ticker", 3, 100).alias("Ticker"), "Target_Weight", F.lit(1.0 / len(ASSETS)).alias("Current_Weight"))
    feats = features.series_features(panel, only=["rolling_vol"])
    recs_ = signals.recommendations(own, feats, fx.bar_sentiment_of(bars), weights, CFG)
    return recs_.withColumns({"Model": F.lit(declared["Declared"]), "Status": F.lit(declared["Status"]), "Beats_MAE": F.lit(declared["Beats_MAE"])})
