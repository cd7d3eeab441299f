"""Embedding whitening by polarisation covariance.

Entries become integers x = floor(1024 * c) + 100000, so that every sum is exact. Covariances come from variances alone:
cov(i, j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2, with the sum of exact squared centred values of every dimension and of
every sum of two dimensions aggregated over Spark. Values are centred before they are squared: on the integer nearest the mean
in the tasks, and from there on the mean itself in exact integers, as n * x - S = n * y - T for y = x - m and T = S - n * m.

Three passes over the rows: n and S, the squares, and the whitened covariance of the result, which is measured and not inferred.
The driver holds a number for each pair of dimensions, whatever the number of rows, and the eigenvectors are one broadcast of the
same size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import map_batches, read
from loomspan.llm.registry import query

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
ROWS = 1024  # rows handled at once
NARROW = 1 << 25  # centred values below this are squared in 64 bits: (2 * NARROW) ** 2 * ROWS < 2 ** 63


@dataclass
class Whitening:
    """n, exact sums S, eigenvalues and unit eigenvectors (rows) by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once: the integer part of the mean is taken off exactly first."""
        whole = np.array([s // self.n for s in self.sums], x.dtype)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def defined(self) -> np.ndarray:
        """Which of the first components have a variance beyond rounding."""
        values = self.values[:COMPONENTS]
        return values > max(self.trace, 0.0) * np.finfo(float).eps * len(self.values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over sqrt(eigenvalue); NaN for a component without variance."""
        scale = np.sqrt(np.where(self.defined(), self.values[:COMPONENTS], np.nan))
        return self.centred(x) @ self.vectors[:COMPONENTS].T / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) squared, exact."""
        return [sum(d * d for d in (self.n * v - s for v, s in zip(row, self.sums, strict=True))) for row in x.tolist()]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and raw: x as little-endian 64-bit integers, of rows whose vector is neither null nor empty nor holds null or non-finite
    entries. Vectors of another length than the most frequent one (ties: the longer) are left out, as no covariance relates
    them. Entries beyond 2 ** 48 have no exact x in a double's steps and raise an error."""
    def step(batch):
        column = batch.column(1)
        lengths = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        good = np.isfinite(flat)
        ends = np.cumsum(lengths)
        raws = []
        for size, end in zip(lengths.tolist(), ends.tolist(), strict=True):
            part = flat[end - size:end]
            if not size or not good[end - size:end].all():
                raws.append(None)
                continue
            if np.abs(part).max() >= 2.0 ** 48:
                raise ValueError("an embedding holds a value of 2 ** 48 or more")
            raws.append((np.floor(SCALE * part).astype("<i8") + SHIFT).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], names=["vec_id", "raw"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = map_batches(embeddings.select("vec_id", "embedding"), step, f"vec_id {kind}, raw binary").where("raw IS NOT NULL")
    sizes = rows.groupBy(F.length("raw").alias("size")).count().orderBy("count", "size", ascending=False).limit(1).collect()
    return rows.where(F.length("raw") == (sizes[0]["size"] if sizes else 0))


def _matrix(raws) -> np.ndarray:
    return np.frombuffer(b"".join(r.as_py() for r in raws), "<i8").reshape(len(raws), -1)


def _exact_sums(rows: DataFrame, step, label: str) -> dict[int, int]:
    """Adds what step gives for a matrix, an array of exact integers by key, over all rows."""
    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.column(0).slice(begin, ROWS)
                if len(part):
                    for key, value in step(_matrix(part)):
                        total[key] = total.get(key, 0) + value
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([str(v) for v in total.values()])], names=["key", label])

    found = rows.select("raw").mapInArrow(run, f"key long, {label} string").groupBy("key").agg(F.sum(F.col(label).cast("decimal(38,0)")).alias(label))
    return {key: int(value) for key, value in found.collect()}


def _sums(x: np.ndarray):
    """Number of rows at key -1 and the sum of each dimension; 48-bit entries of ROWS rows fit 64 bits."""
    yield -1, len(x)
    yield from enumerate(int(v) for v in (x - SHIFT).sum(axis=0) + SHIFT * len(x))


def _squares(centre: np.ndarray):
    """Sums of squares of every centred dimension and of every sum of two."""
    def step(x: np.ndarray):
        y = x - centre
        if y.size and np.abs(y).max() >= NARROW:
            y = y.astype(object)  # numbers without a bound
        d = y.shape[1]
        for i in range(d):
            alone = y[:, i:i + 1]
            both = np.concatenate([alone, alone + y[:, i + 1:]], axis=1)
            for j, value in enumerate((both * both).sum(axis=0), i):
                yield i * d + j, int(value)
    return step


def covariance(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and the covariance matrix of x, each entry an exact fraction rounded once."""
    first = _exact_sums(rows, _sums, "total")
    n = first.pop(-1, 0)
    d = len(first)
    sums = [first[i] for i in range(d)]
    if not n:
        return 0, [], np.zeros((0, 0))
    centre = [(2 * s + n) // (2 * n) for s in sums]  # integer nearest the mean
    rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
    raw = _exact_sums(rows, _squares(np.array(centre, np.int64)), "squares")

    def squares(i: int, j: int) -> int:
        """Sum of (n * x - S) squared over rows, for dimension i (i = j) or the sum of two."""
        t = rest[i] if i == j else rest[i] + rest[j]
        return n * n * raw[i * d + j] - n * t * t

    alone = [squares(i, i) for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = alone[i] / n ** 3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (squares(i, j) - alone[i] - alone[j]) / (2 * n ** 3)
    return n, sums, out


def fit(rows: DataFrame) -> Whitening:
    """Components of usable rows, by falling eigenvalue."""
    n, sums, v = covariance(rows)
    values, vectors = np.linalg.eigh(v) if n else (np.zeros(0), np.zeros((0, 0)))
    return Whitening(n, sums, values[::-1], np.ascontiguousarray(vectors[:, ::-1].T), float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance; None without any.

    The rows are whitened and measured; sums of products are added up by pair of components.
    """
    use = np.flatnonzero(model.defined()) if model.n else []
    if not len(use):
        return None
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total, cross = np.zeros(len(use)), np.zeros((len(use), len(use)))
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.column(0).slice(begin, ROWS)
                if len(part):
                    w = sent.value.whitened(_matrix(part))[:, use]
                    total += w.sum(axis=0)
                    cross += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(use) * (len(use) + 1))), pa.array(np.concatenate([total, cross.ravel()]))], names=["key", "value"])

    found = dict(rows.select("raw").mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value")).collect())
    flat = np.array([found[k] for k in range(len(found))]) / model.n
    mean, cross = flat[:len(use)], flat[len(use):].reshape(len(use), -1)
    return float(np.abs(cross - np.outer(mean, mean) - np.eye(len(use))).max())


def whiten(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component up to COMPONENTS.

    deviation is an exact decimal. A component without variance (one row, equal rows, dependent dimensions) has null for whitened and is
    left out of identity_error, which is null if there is no other; explained is null if nothing varies. Null ids and repeated rows stay,
    zero vectors too; an empty table gives no rows. Other columns are not read.
    """
    rows = usable(embeddings)
    model = fit(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    error = identity_error(rows, model)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    k = min(COMPONENTS, len(model.values))
    explained = [float(v) / model.trace if model.trace > 0 else None for v in np.maximum(model.values[:k], 0.0)]

    def step(batch):
        x = _matrix(batch.column(1))
        w = sent.value.whitened(x).ravel()
        of = np.repeat(np.arange(len(x)), k)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(of), model_n, np.int64)),
             pa.array([str(v) for v in sent.value.deviations(x)]).take(pa.array(of)), pa.array(w, mask=np.isnan(w)), pa.array(explained * len(x), pa.float64()),
             pa.array([error] * len(of), pa.float64())], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    model_n = model.n
    out = map_batches(rows, step, f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double", rows=ROWS)
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    """deviation is a long here: beyond 2 ** 63, which takes some 10 ** 8 rows of unit vectors, the cast raises an error."""
    return whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))
