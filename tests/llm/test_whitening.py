"""Whitening against NumPy on all rows at once and exact integers, with odd rows."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import whitening

NAN, INF = float("nan"), float("inf")


def brute(vectors):
    x = [[int(np.floor(1024.0 * float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n ** 3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    return n, [sum(c * c for c in r) for r in z], v, values[::-1], vectors[:, ::-1], np.array(z, float) / n


def check(rows, vectors_by_id):
    ids = sorted(vectors_by_id)
    n, deviations, v, values, vectors, centred = brute([vectors_by_id[i] for i in ids])
    k = min(8, len(values))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    w = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        sign = np.sign(w[:, c] @ want[:, c])
        assert np.allclose(w[:, c], sign * want[:, c], rtol=1e-9, atol=1e-9)
    error = np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max()
    for i, deviation in zip(ids, deviations, strict=True):
        for c in range(k):
            r = got[i, c + 1]
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert abs(r.explained - values[c] / np.trace(v)) <= 1e-9 * r.explained
            assert abs(r.identity_error - error) < 1e-9 and r.identity_error <= 1e-4


@pytest.mark.parametrize("d,spread", [(12, 1.0), (3, 1e-2), (9, 3e5)])
def test_against_numpy(spark, d, spread):
    """The widest vectors do not fit the 64-bit squares."""
    rng = np.random.default_rng(d)
    base = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) * spread + rng.normal(size=d) * 5
    vectors = {i: [float(np.float32(c)) for c in v] for i, v in enumerate(base)}
    vectors[300], vectors[301] = vectors[0], [0.0] * d  # a repeated row and a zero vector
    odd = [(900, None), (901, []), (902, [NAN] + [0.0] * (d - 1)), (903, [None] + [0.0] * (d - 1)), (904, [INF] * d), (905, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, "clash") for i, v in [*vectors.items(), *odd]], "vec_id long, embedding array<float>, whitened string").repartition(4)
    check(whitening.whiten(docs).collect(), vectors)


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(50, 5)))], "vec_id long, embedding array<double>")
    _, _, want, *_ = brute([r.embedding for r in docs.collect()])
    n, sums, v = whitening.covariance(whitening.usable(docs))
    assert n == 50 and (v == want).all() and len(sums) == 5


def test_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [NAN])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], schema)).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(c, None, None, None, 0) for c in (1, 2, 3)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)] + [(None, [3.0, 6.0, 0.0])], schema)).collect()
    assert len(line) == 33
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in line)
    assert abs(next(r.explained for r in line if r.component == 1) - 1) < 1e-9


def test_too_wide_entries_raise(spark):
    docs = spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="2 \\*\\* 48"):
        whitening.whiten(docs).collect()


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    good = table.where("embedding IS NOT NULL").where(~F.exists("embedding", lambda c: c.isNull() | F.isnan(c))).collect()
    check(whitening.op13_whitening(spark, sf).collect(), {r.vec_id: r.embedding for r in good})
