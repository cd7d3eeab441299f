"""Histogram boosting: trees against a plain recomputation, absent values, subsampling, early stop, an injected signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.operators import boosting

NAMES = ["a", "b", "c"]


def table(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 2] = np.round(x[:, 2])
    y = np.where(x[:, 0] > 0.3, 1.0, -1.0) + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.1, n)
    x[rng.random(n) < 0.15, 1] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, Target double").repartition(5)


def plain_tree(bins, missing, g, depth):
    """Nested dicts: the best split of each node by trying every column, cut and side of absent values."""
    def leaf(at):
        return -g[at].sum() / (at.sum() + 1.0)

    def grow(at, level):
        best = (1e-12, None)
        for c in range(bins.shape[1]) if level < depth else ():
            for side in (True, False):
                for cut in range(missing[c]):
                    left = at & np.where(bins[:, c] == missing[c], side, bins[:, c] <= cut)
                    right = at & ~left
                    if left.sum() >= 1 and right.sum() >= 1:
                        gain = g[left].sum() ** 2 / (left.sum() + 1) + g[right].sum() ** 2 / (right.sum() + 1) - g[at].sum() ** 2 / (at.sum() + 1)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (c, cut, side, left, right))
        if best[1] is None:
            return leaf(at)
        c, cut, side, left, right = best[1]
        return c, cut, side, grow(left, level + 1), grow(right, level + 1)

    return grow


def plain_value(node, row, missing):
    while isinstance(node, tuple):
        c, cut, side, left, right = node
        node = left if (side if row[c] == missing[c] else row[c] <= cut) else right
    return node


@pytest.mark.parametrize("subsample", [1.0, 0.7])
def test_first_trees_against_a_plain_search(spark, subsample):
    x, y = table()
    df = frame(spark, x, y)
    model = boosting.fit(df, NAMES, rounds=2, rate=0.3, depth=3, subsample=subsample, bins=8, keys=["i"])
    bins, missing = boosting.to_bins(x, model.edges), model.missing()
    ids = np.array([r[0] for r in df.sort("i").select(F.xxhash64("i")).collect()])
    forecast = np.full(len(y), y.mean())
    for number in range(2):
        use = boosting.drawn(ids, number, 42, subsample)
        assert use.all() if subsample == 1.0 else 0.6 < use.mean() < 0.8
        node = plain_tree(bins, missing, forecast - y, 3)(use, 0)
        value = np.array([plain_value(node, r, missing) for r in bins])
        tree = model.trees[number]
        np.testing.assert_allclose(tree.value[tree.nodes(bins, missing)], value, rtol=1e-9, atol=1e-12)
        forecast = forecast + 0.3 * value
    got = {r.i: r.prediction for r in model.transform(df).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(y))], forecast, rtol=1e-9)


def test_forecasts_written_on_the_way_change_nothing(spark, monkeypatch):
    x, y = table(300, 1)
    df = frame(spark, x, y)
    whole = boosting.fit(df, NAMES, rounds=7, depth=2, subsample=0.9, bins=16, keys=["i"])
    monkeypatch.setattr(boosting, "REFRESH", 2)
    parts = boosting.fit(df, NAMES, rounds=7, depth=2, subsample=0.9, bins=16, keys=["i"])
    for a, b in zip(whole.trees, parts.trees, strict=True):
        assert (a.column == b.column).all() and (a.cut == b.cut).all()
        np.testing.assert_allclose(a.value, b.value, rtol=1e-9, atol=1e-12)


def test_early_stop_and_signal(spark):
    x, y = table(1200, 2)
    df = frame(spark, x, y)
    valid = F.col("i") % 4 == 0
    model = boosting.fit(df, NAMES, rounds=60, rate=0.5, depth=4, subsample=0.7, bins=32, valid=valid, patience=4, keys=["i"])
    assert 3 < len(model.trees) < 60 and len(model.errors) >= len(model.trees) and min(model.errors) == model.errors[len(model.trees) - 1]
    held = model.transform(df.where(valid)).select("Target", "prediction").toPandas()
    assert np.mean((held.Target - held.prediction) ** 2) == pytest.approx(min(model.errors), rel=1e-9)
    assert (held.Target - held.prediction).abs().mean() < 0.5 * held.Target.abs().mean()  # the naive forecast is 0


def test_odd_columns(spark):
    rows = [(1.0, None, float("nan"), 2.0, 1.0), (1.0, None, float("inf"), 3.0, 2.0), (1.0, None, 1.0, 4.0, None)]
    df = spark.createDataFrame(rows, "k double, a double, b double, c double, Target double")
    model = boosting.fit(df, ["k", "a", "b", "c"], rounds=3, depth=2)
    assert all(np.isfinite(r.prediction) for r in model.transform(df).collect())
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(df.where("Target > 9"), ["k"], rounds=1)
