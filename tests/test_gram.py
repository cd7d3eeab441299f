"""Products in tiles against NumPy: moments, ridge paths, column filter over many columns."""

import numpy as np
import pandas as pd
import pytest

from loomspan.operators import gram, labels, models


@pytest.fixture()
def small_tiles(monkeypatch):
    monkeypatch.setattr(gram, "TILE", 3)
    monkeypatch.setattr(gram, "ROWS", 7)


def frame(spark, x, names):
    return spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(5)


def test_moments(spark, small_tiles):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 8)) * 10.0 ** np.arange(8) + 1e6
    x[::4, 2], x[:, 5], x[3, 0], x[:, 6] = np.nan, 4.0, np.inf, np.nan
    names = [f"c{i}" for i in range(8)]
    got = gram.moments(frame(spark, x, names), names)
    x[~np.isfinite(x)] = np.nan
    use = [0, 1, 2, 3, 4, 5, 7]
    assert (got.n == np.isfinite(x).sum(axis=0)).all() and np.isnan([got.mean[6], got.low[6], got.high[6]]).all()
    for mine, want in ((got.mean, np.nanmean(x[:, use], axis=0)), (got.sd, np.nanstd(x[:, use], axis=0)),
                       (got.low, np.nanmin(x[:, use], axis=0)), (got.high, np.nanmax(x[:, use], axis=0))):
        np.testing.assert_allclose(mine[use], want, rtol=1e-10, atol=1e-12)
    nothing = gram.moments(spark.createDataFrame([], "a double, b double"), ["a", "b"])
    assert (nothing.n == 0).all() and np.isnan(nothing.mean).all()


def test_products_by_group(spark, small_tiles):
    rng = np.random.default_rng(1)
    x, group = rng.normal(size=(60, 7)), np.arange(60) % 3
    names = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(g=group, h="x"))
    got = gram.products(df, ["g", "h"], names, np.zeros(7), np.ones(7))
    assert sorted(got) == [(0, "x"), (1, "x"), (2, "x")]
    for (g, _), total in got.items():
        z = np.c_[np.ones((group == g).sum()), x[group == g]]
        np.testing.assert_allclose(total, z.T @ z, rtol=1e-12, atol=1e-12)


def test_ridge_search_is_the_single_fits(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 4)) * [1.0, 50.0, 1e-3, 1.0] + [0, 9, 0, 0]
    x[:, 3] = 2.0  # constant on all rows
    y = x @ [0.5, 0.01, 100.0, 0.0] + rng.normal(0, 0.4, n)
    fold, role = np.arange(n) % 2, np.where(np.arange(n) < 300, "train", "validate")
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(Target=y, Fold=fold, Role=role)).repartition(4)
    alphas = [0.1, 10.0, 1000.0]
    got = models.ridge_search(df, names, alphas)
    for a, errors in zip(alphas, got, strict=True):
        for k, error in enumerate(errors):
            t, v = (fold == k) & (role == "train"), (fold == k) & (role == "validate")
            mean, sd = x[t].mean(axis=0), x[t].std(axis=0)
            sd[3] = 1.0
            z = (x - mean) / sd
            w = np.linalg.solve(z[t].T @ z[t] + a * np.eye(4), z[t].T @ (y[t] - y[t].mean()))
            assert error == pytest.approx(np.abs(y[v] - z[v] @ w - y[t].mean()).mean(), rel=1e-9)
    log = models.walk_forward_search(df, names, "Ridge", [{"alpha": a} for a in alphas])
    assert log[0]["mean_mae"] == min(e["mean_mae"] for e in log) and len(log) == 3


def plain_filter(x, tol=1e-8, least=10):
    """Kept columns by looking at every pair."""
    kept = []
    for j in range(x.shape[1]):
        b = x[:, j]
        drop = False
        if np.isfinite(b).sum() >= least and np.nanmin(b) < np.nanmax(b):
            for i in kept:
                a = x[:, i]
                both = np.isfinite(a) & np.isfinite(b)
                if both.sum() < least or a[both].min() == a[both].max() or np.isfinite(a).sum() < least:
                    continue
                slope, level = np.polyfit(a[both] - a[both].mean(), b[both], 1)
                drop |= np.abs(b[both] - slope * (a[both] - a[both].mean()) - level).max() / max(1.0, np.abs(b[both]).max()) < tol
        if not drop:
            kept.append(j)
    return kept


@pytest.mark.parametrize("seed", [0, 1])
def test_filter_against_every_pair(spark, small_tiles, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(80, 5))
    columns = []
    for k in range(24):
        c = base[:, rng.integers(5)] * rng.choice([-2.0, 1.0, 1e4]) + rng.choice([0.0, 7.0])
        c = c + rng.choice([0.0, 0.0, 1e-3, 1e-12]) * rng.normal(size=80)
        if k % 5 == 0:
            c[rng.random(80) < 0.3] = np.nan
        columns.append(np.full(80, 3.0) if k == 11 else np.full(80, np.nan) if k == 17 else c)
    x = np.stack(columns, axis=1)
    names = [f"c{i}" for i in range(24)]
    assert models.collinearity_filter(frame(spark, x, names), names) == [names[j] for j in plain_filter(x)]
    assert models.collinearity_filter(frame(spark, x, names).limit(0), names) == names


def test_filter_over_many_columns(spark):
    """600 columns, of which all but 200 are affine copies: the work is passes over the table, whatever the number of pairs."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(50, 200))
    x = np.concatenate([base, base * 3 + 1, -base], axis=1)
    names = [f"c{i}" for i in range(600)]
    assert models.collinearity_filter(frame(spark, x, names), names) == names[:200]


def test_feasible_folds():
    """What the rule for folds makes of the answer leaves rows to train on, and one fold more would not (or the wish is met)."""
    def needed(n, wanted):
        k = max(2, min(wanted, max(2, n // 400)))
        return k * max(500, n // (k + 2))

    for n in (1001, 1200, 1614, 1999, 2001, 2400, 2600, 5000, 100_000):
        k = labels.feasible_folds(n)
        assert needed(n, k) < n and (k == 5 or needed(n, k + 1) >= n)
    with pytest.raises(ValueError, match="too few"):
        labels.feasible_folds(1000)
