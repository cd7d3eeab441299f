"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Vectors are cut into two halves, and each half is quantised on its own, so that CODES centroids a half make CODES^2 cells.
For inner products a half gets one more component, sqrt(bound^2 - |half|^2), where bound is the largest norm of that half; then a
query's distance to a half falls exactly as the inner product rises. A query visits cells in the order of the sum of its two
centroid distances, taken from a heap, until the cells hold SHARE of all entries (at least LEAST), and what they hold is
ranked again by the exact inner product.

Centroids are fitted on a bounded sample (SAMPLE rows by hash); every row is indexed. The driver holds the centroids and the sizes
of the CODES^2 cells. Cells are dealt into parts of about PART rows, queries into lots of about LOT, and a task ranks one lot against
one part in blocks of a matrix product; a hot cell is just several parts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import read
from loomspan.llm.registry import query
from loomspan.llm.vectors import common_length, matrix, usable

CODES = 64
SAMPLE = 20_000
SHARE = 0.5  # of all entries that a query looks at; measured for a recall of 0.9 on vectors without clusters
LEAST = 1_000
PART = 4_000
LOT = 1_000
ROUNDS = 12
QUERY_EVERY = 20
NEAREST = 20


def _lift(half: np.ndarray, bound: float) -> np.ndarray:
    return np.column_stack([half, np.sqrt(np.maximum(0.0, bound - (half * half).sum(axis=1)))])


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances without the part that depends on the point alone."""
    return (centroids * centroids).sum(axis=1) - 2.0 * points @ centroids.T


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spread rows of the sample."""
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(ROUNDS):
        mine = _distances(points, centroids).argmin(axis=1)
        counts = np.bincount(mine, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


class Quantiser:
    """Two codebooks over lifted halves."""

    def __init__(self, sample: np.ndarray, bounds: tuple[float, float], codes: int):
        self.cut, self.bounds = sample.shape[1] // 2, bounds
        self.books = [k_means(_lift(h, b), codes) for h, b in zip(self.halves(sample), bounds, strict=True)]
        self.shape = tuple(len(b) for b in self.books)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.cut], x[:, self.cut:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell number of each row: first code times the number of second codes, plus the second."""
        first, second = (_distances(_lift(h, b), c).argmin(axis=1) for h, b, c in zip(self.halves(x), self.bounds, self.books, strict=True))
        return first * self.shape[1] + second

    def visits(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """Cells in the order of the summed distance until they hold wanted entries; empty cells are passed over."""
        first, second = (_distances(np.append(h, 0.0)[None, :], c)[0] for h, c in zip((q[:self.cut], q[self.cut:]), self.books, strict=True))
        one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        a, b = first[one].tolist(), second[two].tolist()
        one, two, wide, size = one.tolist(), two.tolist(), self.shape[1], sizes.tolist()
        heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
        taken = [0] * len(a)  # per place of the first half: how many of its pairs were taken; a pair waits for both neighbours
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            taken[i] = j + 1
            cell = one[i] * wide + two[j]
            if size[cell]:
                out.append(cell)
                held += size[cell]
            if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < len(a) and taken[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        return np.array(out, np.int64)


def best(ids: np.ndarray, rows: np.ndarray, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest exact inner products, ties to smaller ids; rough scores only pick who is computed exactly."""
    if len(ids) > k:
        near = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1.0 + np.abs(rough).max()))
        ids, rows = ids[near], rows[near]
    scores = (rows * q).sum(axis=1)
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(embeddings: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST, codes: int = CODES, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose vec_id is divisible by every.

    Rows that usable() leaves out neither ask nor answer. Equal scores rank by vec_id; rows that repeat a vec_id are separate
    candidates, none of them for a query of that id. Fewer candidates than k give fewer rows, an empty table none.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings).withColumn("raw_length", F.length("raw"))
    length = common_length(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if not length:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("raw_length") == length).select(F.col("vec_id").cast("long").alias("vec_id"), "raw")

    def norms(batches):
        for batch in batches:
            x = matrix(batch["raw"])
            cut = x.shape[1] // 2
            yield pd.DataFrame({"a": [(x[:, :cut] ** 2).sum(axis=1).max()], "b": [(x[:, cut:] ** 2).sum(axis=1).max()], "n": [len(x)]})

    a, b, n = rows.mapInPandas(norms, "a double, b double, n long").agg(F.max("a"), F.max("b"), F.sum("n")).first()
    draw = F.pmod(F.xxhash64("vec_id", F.lit("codebook sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < min(1.0, SAMPLE / n)).orderBy("vec_id").limit(2 * SAMPLE).collect() or rows.limit(SAMPLE).collect()
    index = Quantiser(matrix([r["raw"] for r in sample]), (a, b), codes)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cell": sent.value.cells(matrix(batch["raw"])), "raw": batch["raw"]})

    entries = rows.mapInPandas(assign, "vec_id long, cell int, raw binary")
    sizes = np.zeros(index.shape[0] * index.shape[1], np.int64)
    for cell, count in entries.groupBy("cell").count().collect():
        sizes[cell] = count
    groups = int(min(index.shape[0], max(1, n // PART)))  # groups of first codes
    of_cell = np.arange(len(sizes)) // index.shape[1] * groups // index.shape[0]
    parts = np.maximum(1, -(-np.bincount(of_cell, weights=sizes, minlength=groups).astype(np.int64) // (2 * PART)))
    first_part = np.concatenate(([0], np.cumsum(parts)))
    lots = max(1, -(-int(n) // (every * LOT)))
    wanted = int(max(least, np.ceil(share * n)))

    def deal(batches):
        for batch in batches:
            group = of_cell[batch["cell"].to_numpy()]
            spread = batch["vec_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            yield batch.assign(part=first_part[group] + spread.astype(np.int64) % parts[group])

    def route(batches):
        for batch in batches:
            for vec_id, raw in zip(batch["vec_id"], batch["raw"], strict=True):
                cells = sent.value.visits(matrix([raw])[0], sizes, wanted)
                seen = np.zeros(len(sizes), np.uint8)
                seen[cells] = 1
                bits = np.packbits(seen).tobytes()
                to = np.concatenate([np.arange(first_part[g], first_part[g + 1]) for g in np.unique(of_cell[cells])] or [np.empty(0, np.int64)])
                yield pd.DataFrame({"part": to, "vec_id": vec_id, "raw": [raw] * len(to), "seen": [bits] * len(to)})

    lot = F.pmod(F.xxhash64("vec_id", F.lit("lot")), F.lit(lots))
    asked = (rows.where(F.col("vec_id") % every == 0).mapInPandas(route, "part long, vec_id long, raw binary, seen binary").withColumn("lot", lot))
    held = (entries.mapInPandas(deal, "vec_id long, cell int, raw binary, part long")
            .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long")))))

    def rank(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            x, ids, cells = matrix(candidates["raw"]), candidates["vec_id"].to_numpy(), candidates["cell"].to_numpy()
            for begin in range(0, len(queries), 256):
                some = queries.iloc[begin:begin + 256]
                q = matrix(some["raw"])
                rough = q @ x.T
                for i, (query_id, bits) in enumerate(zip(some["vec_id"], some["seen"], strict=True)):
                    seen = np.unpackbits(np.frombuffer(bits, np.uint8))[cells].astype(bool) & (ids != query_id)
                    at = np.flatnonzero(seen)
                    found, scores = best(ids[at], x[at], q[i], rough[i][at], k)
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": found, "score": scores}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    partial = asked.groupBy("part", "lot").cogroup(held.groupBy("part", "lot")).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op2_nearest_vectors")
def op2_nearest_vectors(spark, sf_dir):
    return search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
