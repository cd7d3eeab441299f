"""Sums of products of many columns in one pass, as mergeable tiles.

Rows become matrices inside the tasks; a task gives one row of sums per tile of TILE x TILE columns (and per group of rows, such as
a fold), and rows of sums are added up in two exchanges, so that neither a task nor the driver holds more than a bounded
number of tiles of one place. Values are shifted and scaled by the moments of their column first, which keeps the digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

TILE = 256
LANES = 64  # tasks whose sums are added up first
ROWS = 2048


def matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """Columns from `first` on as doubles; null and non-finite values are NaN."""
    out = np.empty((batch.num_rows, batch.num_columns - first))
    for j in range(out.shape[1]):
        out[:, j] = batch.column(first + j).cast(pa.float64()).to_numpy(zero_copy_only=False)
    out[~np.isfinite(out)] = np.nan
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def merged(rows: DataFrame, keys: list[str], add: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Rows (keys, task, sums) to one row (keys, sums) each; add puts the arrays of one key together, in lanes of tasks first."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def together(part: pd.DataFrame) -> pd.DataFrame:
        total = add([np.frombuffer(b) for b in part["sums"]])
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "task": [0], "sums": [total.tobytes()]})

    lanes = rows.withColumn("_lane", F.pmod("task", F.lit(LANES))).groupBy(*keys, "_lane").applyInPandas(together, f"{kinds}, task int, sums binary")
    return lanes.groupBy(*keys).applyInPandas(together, f"{kinds}, task int, sums binary").drop("task")


@dataclass
class Moments:
    """Of every column: number of finite values, mean, population deviation, least and largest (NaN where there is none)."""

    n: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _join_moments(parts: list[np.ndarray]) -> np.ndarray:
    """Counts, means, sums of squared deviations, least and largest of two sets of rows after the other."""
    n, mean, m2, low, high = parts[0].reshape(5, -1).copy()
    for part in parts[1:]:
        k, other, more, lo, hi = part.reshape(5, -1)
        total = np.maximum(n + k, 1.0)
        step = np.where((n > 0) & (k > 0), other - mean, 0.0)
        mean = np.where(n > 0, mean + step * k / total, other)
        m2, n = m2 + more + step * step * n * k / total, n + k
        low, high = np.fmin(low, lo), np.fmax(high, hi)
    return np.concatenate([n, mean, m2, low, high])


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """One pass over the columns; a row of five numbers per column reaches the driver."""
    def run(batches):
        held = None
        for batch in _sliced(batches):
            x = matrix(batch)
            if not len(x):
                continue
            n = np.isfinite(x).sum(axis=0)
            mean = np.nansum(x, axis=0) / np.maximum(n, 1)
            m2 = np.nansum((x - mean) ** 2, axis=0)
            none = np.full((1, x.shape[1]), np.nan)
            part = np.concatenate([n, mean, m2, np.fmin.reduce(np.concatenate([x, none])), np.fmax.reduce(np.concatenate([x, none]))])
            held = part if held is None else _join_moments([held, part])
        if held is not None:
            table = held.reshape(5, -1)
            begins = range(0, table.shape[1], TILE)
            yield pa.RecordBatch.from_arrays([pa.array(list(begins), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(begins), pa.int32()),
                                              pa.array([table[:, b:b + TILE].tobytes() for b in begins])], names=["tile", "task", "sums"])

    rows = _doubles(df, columns).mapInArrow(run, "tile int, task int, sums binary")
    found = sorted(merged(rows, ["tile"], _join_moments).collect())
    if not found:
        nothing = np.full(len(columns), np.nan)
        return Moments(np.zeros(len(columns)), *[nothing] * 4)
    n, mean, m2, low, high = np.concatenate([np.frombuffer(bytes(r["sums"])).reshape(5, -1) for r in found], axis=1)
    return Moments(n, np.where(n > 0, mean, np.nan), np.sqrt(m2 / np.where(n > 0, n, np.nan)), low, high)


def _added(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


def products(df: DataFrame, keys: list[str], columns: list[str], shift: np.ndarray, scale: np.ndarray) -> dict[tuple, np.ndarray]:
    """For each value of the key columns, Z'Z of Z = [1, (columns - shift) / scale] over its rows; rows must be complete.

    Groups are few (folds, roles); the result is as large as groups x columns squared.
    """
    width = len(columns) + 1

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in _sliced(batches):
            names = [batch.column(i).to_pylist() for i in range(len(keys))] if keys else []
            z = np.concatenate([np.ones((batch.num_rows, 1)), (matrix(batch, len(keys)) - shift) / scale], axis=1)
            of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*names, strict=True) if keys else [()] * len(z)):
                of.setdefault(key, []).append(i)
            for key, at in of.items():
                part = z[at].T @ z[at]
                held[key] = held[key] + part if key in held else part
        rows = [(*key, a, b, TaskContext.get().partitionId(), total[a:a + TILE, b:b + TILE].tobytes())
                for key, total in held.items() for a in range(0, width, TILE) for b in range(0, width, TILE)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*key_types, pa.int32(), pa.int32(), pa.int32(), pa.binary()], strict=True)],
                                             names=[*keys, "a", "b", "task", "sums"])

    held = df.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])

    key_types = [to_arrow_type(held.schema[k].dataType) for k in keys]
    kinds = "".join(f"`{k}` {held.schema[k].dataType.simpleString()}, " for k in keys)
    tiles = merged(held.mapInArrow(run, f"{kinds}a int, b int, task int, sums binary"), [*keys, "a", "b"], _added)
    out: dict[tuple, np.ndarray] = {}
    for r in tiles.collect():
        whole = out.setdefault(tuple(r[k] for k in keys), np.zeros((width, width)))
        high, wide = (min(TILE, width - r[x]) for x in "ab")
        whole[r["a"]:r["a"] + high, r["b"]:r["b"] + wide] = np.frombuffer(bytes(r["sums"])).reshape(high, wide)
    return out


def close_pairs(df: DataFrame, columns: list[str], of: Moments, bound: np.ndarray, least: int) -> dict[int, list[int]]:
    """For each column j the earlier columns i, ascending, whose linear fit may leave a root mean square residual of at most bound[j].

    Pairs are judged on the rows where both have a value (at least `least` of them, else they are no pair). Four products per
    tile give counts, sums and cross sums of all pairs; only pairs that pass leave the tile's task.
    """
    begins = list(range(0, len(columns), TILE))
    shift, scale = of.mean, np.where(of.sd > 0, of.sd, 1.0)

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in _sliced(batches):
            x = (matrix(batch) - shift) / scale
            there = np.isfinite(x).astype(np.float64)
            x = np.nan_to_num(x, nan=0.0)
            for a in begins:
                for b in begins:
                    if a <= b:
                        xa, wa, xb, wb = (m[:, s:s + TILE] for s in (a, b) for m in (x, there))
                        part = np.stack([wa.T @ wb, xa.T @ wb, wa.T @ xb, (xa * xa).T @ wb, wa.T @ (xb * xb), xa.T @ xb])
                        held[a, b] = held[a, b] + part if (a, b) in held else part
        rows = [(a, b, TaskContext.get().partitionId(), total.tobytes()) for (a, b), total in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                             names=["a", "b", "task", "sums"])

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b, raw in zip(part["a"], part["b"], part["sums"], strict=True):
            high, wide = min(TILE, len(columns) - a), min(TILE, len(columns) - b)
            n, si, sj, sii, sjj, sij = np.frombuffer(raw).reshape(6, high, wide)
            with np.errstate(divide="ignore", invalid="ignore"):
                vi, vj, c = sii - si * si / n, sjj - sj * sj / n, sij - si * sj / n
                left = np.where(vi > 0, vj - c * c / vi, np.inf)  # a column that is constant on these rows explains nothing
                rest = np.sqrt(np.maximum(left, 0.0) / n) * scale[b:b + wide]
                i, j = np.nonzero((n >= least) & (rest <= bound[b:b + wide]) & (np.arange(a, a + high)[:, None] < np.arange(b, b + wide)))
            out.append(pd.DataFrame({"j": j + b, "i": i + a}))
        return pd.concat(out, ignore_index=True)

    tiles = merged(_doubles(df, columns).mapInArrow(run, "a int, b int, task int, sums binary"), ["a", "b"], _added)
    pairs = tiles.groupBy("a", "b").applyInPandas(judge, "j int, i int").groupBy("j").agg(F.array_sort(F.collect_list("i")).alias("i"))
    return {r["j"]: r["i"] for r in pairs.collect()}


def residuals(df: DataFrame, columns: list[str], of: Moments, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the linear fit of column j by column i, for each pair: the largest residual, and the largest |j|, where both have a value."""
    i, j = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    scale = np.where(of.sd > 0, of.sd, 1.0)

    def sides(batch):
        x = matrix(batch)
        u, v = (x[:, i] - of.mean[i]) / scale[i], (x[:, j] - of.mean[j]) / scale[j]
        there = np.isfinite(u) & np.isfinite(v)
        return x, np.where(there, u, 0.0), np.where(there, v, 0.0), there

    def sums(batches):
        held = np.zeros((5, len(i)))
        for batch in _sliced(batches):
            _, u, v, there = sides(batch)
            held += np.stack([there.sum(axis=0), u.sum(axis=0), v.sum(axis=0), (u * u).sum(axis=0), (u * v).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.tobytes()])], names=["tile", "task", "sums"])

    data = _doubles(df, columns)
    n, su, sv, suu, suv = np.frombuffer(bytes(merged(data.mapInArrow(sums, "tile int, task int, sums binary"), ["tile"], _added).head()["sums"])).reshape(5, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = suu - su * su / n
        slope = np.where(spread > 0, (suv - su * sv / n) / spread, 0.0)
        level = (sv - slope * su) / n

    def worst(batches):
        held = np.zeros((2, len(i)))
        for batch in _sliced(batches):
            x, u, v, there = sides(batch)
            if len(x):
                held[0] = np.maximum(held[0], np.where(there, np.abs(v - slope * u - level) * scale[j], 0.0).max(axis=0))
                held[1] = np.maximum(held[1], np.where(there, np.abs(x[:, j]), 0.0).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.tobytes()])], names=["tile", "task", "sums"])

    found = merged(data.mapInArrow(worst, "tile int, task int, sums binary"), ["tile"], lambda parts: np.max(parts, axis=0)).head()
    return tuple(np.frombuffer(bytes(found["sums"])).reshape(2, -1))
