"""Metric join and multi-index against brute force, with odd vectors."""

import numpy as np
import pytest

from loomspan.llm import metric_join, multi_index


def odd_vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8))
    x, labels = [], []
    for _ in range(400):
        v = base[rng.integers(30)] + rng.normal(size=8) * rng.choice([.05, .3, .6])
        x.append((v * rng.choice([1, 2.5])).astype("f4").tolist())
        labels.append(int(rng.integers(2)))
    for i in range(150):
        x.append(x[i % 2])
        labels.append(0)
    x[5], x[6], x[7], x[9], x[10] = None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0] * 3, [None] + [1.0] * 7
    labels[8] = None
    return x, labels


def brute_links(x, labels, least=0.93):
    n = len(x)
    fine = [v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v) and labels[i] is not None for i, v in enumerate(x)]
    v = [np.array(a, "f4").astype(float) if f else None for a, f in zip(x, fine)]
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and labels[i] == labels[j]:
                linked[i, j] = linked[j, i] = v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= least
    root = np.arange(n)
    while True:
        new = np.array([min([root[i], *root[linked[i]]]) for i in range(n)])
        if (new == root).all():
            return linked.sum(axis=1), root
        root = new


@pytest.mark.parametrize("cell,block", [(4000, 1500), (40, 20)])
def test_metric_join(spark, monkeypatch, cell, block):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", block)
    x, labels = odd_vectors()
    df = spark.createDataFrame([(i, l, v, "c") for i, (l, v) in enumerate(zip(labels, x))], "vec_id long, label int, embedding array<float>, rep string")
    got = metric_join.near_vectors(df).toPandas().sort_values("vec_id")
    links, root = brute_links(x, labels)
    assert got.n_links.tolist() == links.tolist() and got.component_id.tolist() == root.tolist()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_metric_join_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, None), (2, 0, None), (3, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<double>")
    rows = sorted((r.vec_id, r.n_links, r.component_id) for r in metric_join.near_vectors(df).collect())
    assert rows == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (2, 0, 2), (3, 0, 3)]
    assert metric_join.near_vectors(df.limit(0)).count() == 0


def exact(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (x * x[i]).sum(axis=1)
        other = ids != ids[i]
        order = np.lexsort((ids[other], -scores[other]))[:k]
        out[int(ids[i])] = list(zip(ids[other][order].tolist(), scores[other][order].tolist()))
    return out


def test_pairs_come_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    q = multi_index.Quantiser(x, ((x[:, :8] ** 2).sum(axis=1).max(), (x[:, 8:] ** 2).sum(axis=1).max()), 20)
    sizes = np.bincount(q.cells(x), minlength=400)
    for v in x[:30]:
        got = q.visits(v, sizes, 10 ** 9)
        first, second = (multi_index._distances(np.append(h, 0.0)[None], c)[0] for h, c in zip((v[:8], v[8:]), q.books))
        summed = (first[:, None] + second[None]).ravel()
        assert sorted(got) == np.flatnonzero(sizes).tolist() and np.allclose(summed[got], np.sort(summed[sizes > 0]))
        some = q.visits(v, sizes, 500)
        assert sizes[some].sum() >= 500 and (some == got[: len(some)]).all()


def test_search_is_exact_when_all_cells_are_visited(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PART", 60)
    monkeypatch.setattr(multi_index, "LOT", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)).astype("f4").astype(float)
    x[100:220] = x[100]  # one vector on many rows, ties by id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(600, None, 0), (620, [0.0] * 8, 0), (640, [float("inf")] + [0.0] * 7, 0), (660, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got: dict[int, list] = {}
    for r in sorted(multi_index.search(df, codes=8).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(np.arange(500), x, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [a for a, _ in got[q]] == [a for a, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.toPandas().sort_values("vec_id")
    want = exact(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float), 20, 20)
    got: dict[int, set] = {}
    for r in multi_index.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in multi_index.search(df).collect()] == [(0, 1, 7, 4.0)]
    assert multi_index.search(df.limit(0)).count() == 0
