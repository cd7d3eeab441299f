"""Column selection, scaling and model fitting on top of Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import boosting, gram
from loomspan.operators.evaluate import hit
from loomspan.session import materialise

NOISE = 5e-5  # residual spread, relative to the column's, that rounding in a correlation can hide


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def collinearity_filter(df: DataFrame, columns: list[str], tol: float = 1e-8, min_rows: int = 10) -> list[str]:
    """Keep a column unless it is an exact affine function of one kept column, in the given order.

    Exact: the largest residual of the fit, relative to the column's largest value (1 at least), is under tol, on the
    rows where both have a finite value. Constant columns and columns with fewer than min_rows finite values stay. The data side
    is a pass for the moments, one for the products of all pairs in tiles, and two for each round of candidates; a column's
    first candidate decides it unless that one has itself been dropped without being its equal.
    """
    if not columns:
        return []
    of = gram.moments(df, columns)
    usable = (of.n >= min_rows) & (of.low < of.high)
    largest = np.maximum(1.0, np.maximum(np.abs(of.low), np.abs(of.high)))
    bound = np.where(usable, tol * largest + NOISE * of.sd, -1.0)  # the mean residual is at most the largest one
    candidates = {j: [i for i in found if usable[i]] for j, found in gram.close_pairs(df, columns, of, bound, min_rows).items()}
    exact: dict[tuple[int, int], bool] = {}
    while True:
        dropped: set[int] = set()
        ask = []
        for j in range(len(columns)):
            for i in candidates.get(j, []):
                if i in dropped:
                    continue
                if (i, j) not in exact:
                    ask.append((i, j))
                if exact.get((i, j), True):  # taken for its equal until the residuals say otherwise
                    dropped.add(j)
                    break
        if not ask:
            return [c for j, c in enumerate(columns) if j not in dropped]
        worst, size = gram.residuals(df, columns, of, ask)
        exact |= {pair: bool(w / max(1.0, s) < tol) for pair, w, s in zip(ask, worst, size, strict=True)}


def standard_scale(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """z-scores with mean and population deviation of the train rows only; a constant column is only centred."""
    fit = df.where(train).agg(*[e for c in columns for e in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    got = fit.select(F.struct(*fit.columns).alias("f")).scalar()
    held = df.withColumn("_f", got)
    spread = {c: F.coalesce(F.nullif(F.col("_f")[f"s_{c}"], F.lit(0.0)), F.lit(1.0)) for c in columns}
    return held.withColumns({c: (F.col(c) - F.col("_f")[f"m_{c}"]) / spread[c] for c in columns}).drop("_f")


@dataclass
class Ridge:
    """Coefficients of the columns as they are, and the intercept."""

    columns: list[str]
    coefficients: DenseVector
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [F.col(c) * float(w) for c, w in zip(self.columns, self.coefficients.toArray(), strict=True)]
        return df.withColumn("prediction", sum(terms, F.lit(self.intercept)))


def _solve(total: np.ndarray, shift: np.ndarray, scale: np.ndarray, alpha: float, standardise: bool) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from Z'Z of Z = [1, x, y] in shifted and scaled units; the intercept carries no penalty."""
    n, sums, cross = total[0, 0], total[0, 1:], total[1:, 1:]
    mean = sums / n
    c = cross - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0.0))
    d = np.where(sd > 1e-12, 1.0 / np.maximum(sd, 1e-12), 1.0) if standardise else scale[:-1]  # units of the penalty
    w = np.linalg.lstsq(c[:-1, :-1] * np.outer(d, d) + alpha * np.eye(len(d)), c[:-1, -1] * d * scale[-1], rcond=None)[0] * d / scale[:-1]
    centre = shift + mean * scale
    return w, float(centre[-1] - w @ centre[:-1])


def fit_ridge(train: DataFrame, columns: list[str], alpha: float = 1.0, label: str = "Target") -> Ridge:
    """Ridge regression with an unpenalised intercept, from the normal equations of one pass; incomplete rows take no part."""
    rows = train.select(*columns, label).dropna()
    of = gram.moments(rows, [*columns, label])
    shift, scale = of.mean, np.where(of.sd > 0, of.sd, 1.0)
    total = gram.products(rows, [], [*columns, label], shift, scale)[()]
    w, level = _solve(total, shift, scale, alpha, standardise=False)
    return Ridge(list(columns), Vectors.dense(w), level)


def fit_forest(train: DataFrame, columns: list[str], label: str = "Target", trees: int = 20, depth: int = 5,
               min_leaf: int = 1, seed: int = 42):
    model = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)
    return model.fit(assemble(train, columns))


def fit_gbt(train: DataFrame, columns: list[str], label: str = "Target", rounds: int = 10, rate: float = 0.1,
            depth: int = 3, subsample: float = 1.0, seed: int = 42):
    model = GBTRegressor(labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=seed)
    return model.fit(assemble(train, columns))


def fit_hist_gbt(train: DataFrame, columns: list[str], label: str = "Target", rounds: int = 400, rate: float = 0.1, depth: int = 5,
                 subsample: float = 0.7, bins: int = 64, held_out: float = 0.15, patience: int = 20, seed: int = 42) -> boosting.Boosted:
    """Histogram boosting that stops by the error on the last `held_out` share of the dates (0: all rounds)."""
    valid = None
    if held_out > 0:
        days = train.agg(F.sort_array(F.collect_set("Date")).alias("d"))  # bounded by civil days
        cut = days.select(F.get("d", F.floor(F.size("d") * (1.0 - held_out)).cast("int"))).head()[0]
        valid = F.col("Date") >= F.lit(cut)
    keys = [c for c in ("Date", "Ticker") if c in train.columns] or None
    return boosting.fit(train, columns, label, rounds, rate, depth, subsample, bins, seed, valid, patience, keys)


FITTERS = {"Ridge": fit_ridge, "RandomForest": fit_forest, "GradientBoosting": fit_gbt, "HistGradientBoosting": fit_hist_gbt}


def predict(model, df: DataFrame, columns: list[str], name: str) -> DataFrame:
    made = model.transform(df.dropna(subset=columns) if isinstance(model, (Ridge, boosting.Boosted)) else assemble(df, columns))
    return made.withColumnRenamed("prediction", "Predicted_Return").drop("features").withColumn("Model", F.lit(name))


def ridge_search(folds: DataFrame, columns: list[str], alphas: list[float], label: str = "Target") -> list[list[float]]:
    """Validation error of every alpha (outer) in every fold (inner), columns scaled by the train rows of the fold.

    A pass for the moments, one for the normal equations of all folds, from which every alpha is solved, and one for the errors
    of all forecasts; folds x columns squared numbers reach the driver.
    """
    rows = folds.select("Fold", "Role", *columns, label).dropna()
    of = gram.moments(rows, [*columns, label])
    shift, scale = of.mean, np.where(of.sd > 0, of.sd, 1.0)
    totals = gram.products(rows.where("Role = 'train'"), ["Fold"], [*columns, label], shift, scale)
    solved = {}
    for (fold,), total in totals.items():
        found = [_solve(total, shift, scale, alpha, standardise=True) for alpha in alphas]
        solved[fold] = np.stack([w for w, _ in found], axis=1), np.array([b for _, b in found])
    sent = folds.sparkSession.sparkContext.broadcast(solved)

    def errors(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, x = np.array(batch.column(0)), gram.matrix(batch, 1)
            for k in np.unique(fold).tolist():
                part = x[fold == k]
                w, b = sent.value[k]
                off = np.abs(part[:, -1:] - (part[:, :-1] @ w + b)).sum(axis=0)
                held[k] = held.get(k, 0.0) + np.append(off, len(part))
        for k, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(total), pa.int32()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["fold", "place", "total"])

    checked = rows.where("Role = 'validate'").select(F.col("Fold").cast("int"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*columns, label])])
    found = {(r["fold"], r["place"]): r["total"] for r in checked.mapInArrow(errors, "fold int, place int, total double").groupBy("fold", "place").agg(F.sum("total").alias("total")).collect()}
    ids = sorted({k for k, _ in found})
    return [[found[k, a] / found[k, len(alphas)] for k in ids] for a in range(len(alphas))]


def walk_forward_search(folds: DataFrame, columns: list[str], name: str, grid: list[dict], label: str = "Target") -> list[dict]:
    """Mean validation error of each parameter set, columns scaled by the train rows of a fold. Sorted by error, best first.

    `folds` has Fold and Role per row. All alphas of a ridge come from one pass; for trees the rows of a fold are scaled and written
    once and the loop is over the few (fold, parameter set) pairs, each a distributed fit.
    """
    if name == "Ridge":
        errors = ridge_search(folds, columns, [p["alpha"] for p in grid], label)
    else:
        errors = [[] for _ in grid]
        for k in sorted(r["Fold"] for r in folds.select("Fold").distinct().collect()):
            part = materialise(standard_scale(folds.where(F.col("Fold") == k), columns, F.col("Role") == "train"), "fold")
            for of, params in zip(errors, grid, strict=True):
                model = FITTERS[name](part.where("Role = 'train'"), columns, label=label, **params)
                scored = predict(model, part.where("Role = 'validate'"), columns, name)
                of.append(scored.agg(F.avg(F.abs(F.col(label) - F.col("Predicted_Return")))).head()[0])
    log = [{"params": p, "fold_mae": e, "mean_mae": sum(e) / len(e)} for p, e in zip(grid, errors, strict=True)]
    return sorted(log, key=lambda e: e["mean_mae"])


def ablation(df: DataFrame, base: list[str], extra: list[str], min_sessions: int = 60, train_share: float = 0.70,
             label: str = "Target", name: str = "GradientBoosting", **params) -> DataFrame:
    """One row: error and direction with and without `extra` on identical rows, 70/30 by date, of the model `name`.

    Fewer than min_sessions dates gives Status 'NOT RUN'.
    """
    spark = df.sparkSession
    days = df.agg(F.sort_array(F.collect_set("Date")).alias("d")).head()["d"]
    schema = ("Status string, Sessions long, MAE_Without double, MAE_With double, DirAcc_Without double, "
              "DirAcc_With double, Delta_MAE double, Delta_DirAcc double, Verdict string")
    if len(days) < min_sessions:
        return spark.createDataFrame([("NOT RUN", len(days), *[None] * 6, None)], schema)
    cut = days[math.floor(len(days) * train_share)]
    rows = df.dropna(subset=[*base, *extra, label])
    scores = {}
    for arm, cols in (("without", base), ("with", base + extra)):
        model = FITTERS[name](rows.where(F.col("Date") < F.lit(cut)), cols, label=label, **params)
        got = predict(model, rows.where(F.col("Date") >= F.lit(cut)), cols, arm)
        scores[arm] = got.agg(
            F.avg(F.abs(F.col(label) - F.col("Predicted_Return"))).alias("mae"),
            F.avg(hit(F.col(label), F.col("Predicted_Return"))).alias("acc")).head()
    w, o = scores["with"], scores["without"]
    d_mae, d_acc = w["mae"] - o["mae"], w["acc"] - o["acc"]
    verdict = "no smaller error" if d_mae >= 0 else "smaller error, better direction" if d_acc > 0 else "smaller error, no better direction"
    return spark.createDataFrame(
        [("COMPLETED", len(days), o["mae"], w["mae"], o["acc"], w["acc"], d_mae, d_acc, verdict)], schema)
