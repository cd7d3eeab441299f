"""Second-order gradient boosting on quantile-binned columns.

Rows are binned once and written: one byte per column, the label and a forecast. A level of a tree is one aggregate: sums of
gradient and hessian by (node, column, bin), with a part per task, from which the driver picks the splits; what it holds is
bounded by nodes x columns x bins. Forecasts of the latest trees are computed in the tasks and written every REFRESH trees, so a lost
executor costs a part of one aggregate. Rows without a value in a column have a bin of their own there and go to the better side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.gram import matrix
from loomspan.session import materialise

REFRESH = 16
ROWS = 8192
PENALTY = 1.0  # on the squared leaf values
LEAST_WEIGHT = 1.0  # least hessian of a side
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


@dataclass
class Tree:
    """Nodes in heap order: children of k are 2 k + 1 and 2 k + 2. column -1 is a leaf; a row goes left if its bin is at most cut."""

    column: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Node of every row, as deep as the tree is split; missing[c] is the bin of absent values."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            column = self.column[at]
            inner = column >= 0
            if not inner.any():
                return at
            found = bins[rows, np.maximum(column, 0)].astype(np.int64)
            left = np.where(found == missing[np.maximum(column, 0)], self.null_left[at], found <= self.cut[at])
            at = np.where(inner, 2 * at + 2 - left, at)


def drawn(ids: np.ndarray, number: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on: a hash of row, tree and seed against the share."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 1_000_003 + number + 1) * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return (x ^ (x >> np.uint64(31))).astype(np.float64) < share * 2.0 ** 64


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin k holds values over edge k - 1 and up to edge k; the last bin those that are absent."""
    out = np.empty(x.shape, np.uint8)
    for c, e in enumerate(edges):
        out[:, c] = np.where(np.isnan(x[:, c]), len(e) + 1, np.searchsorted(e, x[:, c], side="left"))
    return out


@dataclass
class Boosted:
    columns: list[str]
    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[Tree]
    errors: list[float] = field(default_factory=list)  # mean squared error of the validation rows after each tree

    def missing(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges], np.int64)

    def forecast(self, bins: np.ndarray, trees: list[Tree], start: np.ndarray) -> np.ndarray:
        missing, out = self.missing(), start.copy()
        for tree in trees:
            out += self.rate * tree.value[tree.nodes(bins, missing)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction; absent values are allowed."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predict(rows: pd.DataFrame) -> pd.Series:
            model, x = sent.value, rows.to_numpy(np.float64, na_value=np.nan)
            x = np.where(np.isfinite(x), x, np.nan)
            return pd.Series(model.forecast(to_bins(x, model.edges), model.trees, np.full(len(x), model.base)))

        return df.withColumn("prediction", predict(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.columns)])))


def quantile_edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Up to bins - 1 distinct inner quantiles of each column, from one sketch aggregate."""
    points = [k / bins for k in range(1, bins)]
    finite = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns]
    found = df.agg(*[F.percentile_approx(F.nanvl(x, F.lit(None).cast("double")), points, 20 * bins).alias(f"q{i}") for i, x in enumerate(finite)]).head()
    return [np.unique(np.array(q or [], np.float64)) for q in found]


def _best_splits(g: np.ndarray, h: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every node the best (gain, column, cut, absent values left) from sums by (node, column, bin)."""
    nodes, columns, width = g.shape
    place = np.arange(width)
    absent = place[None, :] == missing[:, None]  # (column, bin)
    ga, ha = (np.where(absent, s, 0.0).sum(axis=2) for s in (g, h))
    gl, hl = (np.cumsum(np.where(absent, 0.0, s), axis=2) for s in (g, h))
    total_g, total_h = g.sum(axis=2), h.sum(axis=2)
    best = [np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, bool)]
    for side in (True, False):
        lg, lh = (s + (a[:, :, None] if side else 0.0) for s, a in ((gl, ga), (hl, ha)))
        rg, rh = total_g[:, :, None] - lg, total_h[:, :, None] - lh
        gain = lg * lg / (lh + PENALTY) + rg * rg / (rh + PENALTY) - (total_g * total_g / (total_h + PENALTY))[:, :, None]
        gain = np.where((lh >= LEAST_WEIGHT) & (rh >= LEAST_WEIGHT) & (place < missing[:, None]), gain, -np.inf).reshape(nodes, -1)
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        more = top > best[0]
        best = [np.where(more, new, old) for new, old in zip((top, at // width, at % width, side), best, strict=True)]
    return tuple(best)


def fit(train: DataFrame, columns: list[str], label: str = "Target", rounds: int = 100, rate: float = 0.1, depth: int = 5, subsample: float = 1.0,
        bins: int = 64, seed: int = 42, valid: Column | None = None, patience: int = 20, keys: list[str] | None = None) -> Boosted:
    """Squared error, level by level, up to `rounds` trees of `depth` splits on a hashed share of the rows each.

    With `valid`, rows where it holds are not learned from, and growing stops when their error has not fallen for `patience`
    trees; the trees up to the least error are kept. `keys` name a row for the draw (default: all its values), so equal rows are
    drawn together. Rows without a label take no part; bins are at most 250.
    """
    if not 2 <= bins <= 250:
        raise ValueError("bins must be from 2 to 250")
    rows = train.where(F.col(label).isNotNull())
    marked = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False))
    learn = marked.where(~F.col("_valid"))
    edges = quantile_edges(learn, columns, bins)
    base = learn.agg(F.avg(label)).head()[0]
    if base is None:
        raise ValueError("no rows to learn from")
    model = Boosted(list(columns), edges, float(base), rate, [])
    missing, width, p = model.missing(), max(len(e) for e in edges) + 2, len(columns)
    schema = "bins binary, y double, id long, valid boolean, forecast double"

    def packed(batches):
        for batch in batches:
            binned = to_bins(matrix(batch, 3), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in binned], pa.binary()), *batch.columns[:3], pa.array(np.full(batch.num_rows, base))],
                                             names=["bins", "y", "id", "valid", "forecast"])

    held = materialise(marked.select(F.col(label).cast("double").alias("y"), F.xxhash64(*[F.col(c) for c in (keys or [*columns, label])]).alias("id"), "_valid",
                                     *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).mapInArrow(packed, schema), "boosting-rows").persist()
    written = 0

    def opened(batch):
        y, ids, is_valid, start = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("y", "id", "valid", "forecast"))
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(y), p)
        return raw, y, ids, is_valid.astype(bool), start

    def level_sums(tree: Tree, level: int, recent: list[Tree], number: int):
        """(key, g, h) by (node of the level, column, bin); key -1 holds the squared error and count of the validation rows."""
        def run(batches):
            total = np.zeros((2, 2 ** level * p * width))
            error = np.zeros(2)
            for batch in batches:
                for begin in range(0, batch.num_rows, ROWS):
                    raw, y, ids, is_valid, start = opened(batch.slice(begin, ROWS))
                    off = model.forecast(raw, recent, start) - y
                    if level == 0 and is_valid.any():
                        error += (off[is_valid] ** 2).sum(), is_valid.sum()
                    node = tree.nodes(raw, missing) - (2 ** level - 1)
                    use = ~is_valid & (node >= 0) & drawn(ids, number, seed, subsample)
                    key = ((node[use, None] * p + np.arange(p)) * width + raw[use]).ravel()
                    total[0] += np.bincount(key, np.repeat(off[use], p), total.shape[1])
                    total[1] += np.bincount(key, minlength=total.shape[1])
            seen = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[0][seen], error[0])), pa.array(np.append(total[1][seen], error[1]))], names=["key", "g", "h"])

        found = held.mapInArrow(run, "key long, g double, h double").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        key, g, h = (np.asarray(found.column(c)) for c in ("key", "g", "h"))
        sums = np.zeros((2, 2 ** level * p * width))
        error = None
        if (key < 0).any():
            squares, count = g[key < 0][0], h[key < 0][0]
            error = squares / count if count else None
            key, g, h = key[key >= 0], g[key >= 0], h[key >= 0]
        sums[0][key], sums[1][key] = g, h
        return sums.reshape(2, 2 ** level, p, width), error

    try:
        while len(model.trees) < rounds:
            number, tree = len(model.trees), Tree.stump(depth)
            for level in range(depth):
                (g, h), error = level_sums(tree, level, model.trees[written:], number)
                if level == 0:
                    if error is not None and number:
                        model.errors.append(error)
                        if number - 1 - int(np.argmin(model.errors)) >= patience:
                            break
                    tree.value[0] = -g[0, 0].sum() / (h[0, 0].sum() + PENALTY)
                gain, column, cut, null_left = _best_splits(g, h, missing)
                for k in np.flatnonzero(gain > 1e-12 * np.abs(g).sum()).tolist():
                    at, c = 2 ** level - 1 + k, int(column[k])
                    tree.column[at], tree.cut[at], tree.null_left[at] = c, cut[k], null_left[k]
                    goes = np.where(np.arange(width) == missing[c], null_left[k], np.arange(width) <= cut[k])
                    for child, part in ((2 * at + 1, goes), (2 * at + 2, ~goes)):
                        tree.value[child] = -g[k, c][part].sum() / (h[k, c][part].sum() + PENALTY)
                if not (gain > 1e-12 * np.abs(g).sum()).any():
                    break
            if model.errors and number - 1 - int(np.argmin(model.errors)) >= patience:
                break
            model.trees.append(tree)
            if len(model.trees) - written >= REFRESH:
                held, written = _refreshed(held, model, model.trees[written:], opened, schema), len(model.trees)
        if valid is not None and len(model.errors) < len(model.trees):
            _, error = level_sums(Tree.stump(0), 0, model.trees[written:], -1)
            if error is not None:
                model.errors.append(error)
    finally:
        held.unpersist()
    if model.errors:
        model.trees = model.trees[:int(np.argmin(model.errors)) + 1]
    return model


def _refreshed(held: DataFrame, model: Boosted, trees: list[Tree], opened, schema: str) -> DataFrame:
    """The rows with the forecasts of all trees so far, written anew."""
    def run(batches):
        for batch in batches:
            raw, _, _, _, start = opened(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(model.forecast(raw, trees, start))], names=batch.schema.names)

    fresh = materialise(held.mapInArrow(run, schema), "boosting-rows").persist()
    held.unpersist()
    return fresh
