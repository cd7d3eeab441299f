"""Embedding near-dedup by an exact metric range join.

On unit vectors a cosine of at least MIN_COSINE is a distance of at most radius = sqrt(2 - 2 MIN_COSINE). Each label has pivots; a vector's
home cell is that of its nearest pivot p. It is also a guest in the cell of pivot q if a vector within radius could be at home there:
by the triangle inequality only if (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) <= radius, its distance to the border of the two cells. A cell then
finds all links of its homes among its homes and guests, on its own.

Equal vectors of a label are one class with a count, so a vector that a third of all rows share is one row. Homes and guests of a cell
are cut into blocks of about BLOCK classes by hash, and a task compares two blocks as a matrix product: no pairs are emitted, only each
home's number of links and the root of its component within the block pair. Pivots (at most MAX_PIVOTS, from the sample with the
least hashes, spread apart) steer the cost alone; any choice gives the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import read
from loomspan.llm.components import components
from loomspan.llm.registry import query
from loomspan.llm.vectors import matrix, usable
from loomspan.llm.work import Work

MIN_COSINE = 0.93
CELL = 4_000  # classes of a label per pivot, about
BLOCK = 1_500
MAX_PIVOTS = 2_048
SAMPLE_PER_PIVOT = 8
EDGE = 1e-9  # cosines this near to the bound are computed again without a matrix product


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of unit vectors, each the farthest from those before."""
    chosen = [0]
    near = 2.0 - 2.0 * x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, 2.0 - 2.0 * x @ x[chosen[-1]])
    return x[chosen]


def linked(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of pairs with a cosine of at least least."""
    cosines = unit(a) @ unit(b).T
    i, j = np.nonzero(cosines >= least - EDGE)
    close = np.flatnonzero(cosines[i, j] < least + EDGE)
    drop = [n for n in close.tolist() if math.fsum(a[i[n]] * b[j[n]]) / math.sqrt(math.fsum(a[i[n]] ** 2) * math.fsum(b[j[n]] ** 2)) < least]
    return np.delete(i, drop), np.delete(j, drop)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least place reachable from each of n places over the pairs."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots of the labels with more than CELL classes; their number is bounded by MAX_PIVOTS in all."""
    sizes = classes.groupBy("label").count().where(F.col("count") > CELL).orderBy(F.col("count").desc(), "label").limit(MAX_PIVOTS // 2).collect()
    room = MAX_PIVOTS / max(1, sum(math.ceil(r["count"] / CELL) for r in sizes))
    wanted = {r["label"]: max(2, int(math.ceil(r["count"] / CELL) * min(1.0, room))) for r in sizes}
    if not wanted:
        return {}
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["label"]), F.lit(min(1.0, SAMPLE_PER_PIVOT * wanted[r["label"]] / r["count"])))])
    draw = F.pmod(F.xxhash64("rep", F.lit("pivots")), F.lit(1 << 30)) / float(1 << 30)
    sample: dict[int, list] = {}
    rows = classes.where(F.col("label").isin(list(wanted)) & (draw < share[F.col("label")])).select("label", "rep", "raw")
    for r in rows.limit(2 * SAMPLE_PER_PIVOT * MAX_PIVOTS).collect():
        sample.setdefault(r["label"], []).append((r["rep"], bytes(r["raw"])))
    out = {}
    for label, found in sample.items():
        length = len(found[0][1])
        alike = [raw for _, raw in sorted(found) if len(raw) == length]
        out[label] = spread_pivots(unit(matrix(alike)), wanted[label])
    return out


def near_vectors(embeddings: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row with a vec_id.

    Rows without a label, and vectors that usable() leaves out, link with nothing; so do vectors of different lengths.
    Rows that repeat a vec_id are separate vectors: they count as each other's links when they are alike.
    """
    spark = embeddings.sparkSession
    work = Work(spark, "near-vectors")
    rows = work.keep(usable(embeddings, "label").where("label IS NOT NULL").withColumn("label", F.col("label").cast("long")), "rows")
    classes = work.keep(rows.groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("alike")), "classes")
    sent = spark.sparkContext.broadcast(_pivots(classes))
    radius = math.sqrt(2.0 - 2.0 * least) + 1e-6

    def place(batches):
        for batch in batches:
            for (label, width), some in batch.groupby(["label", batch["raw"].map(len)]):
                some = some.drop(columns="raw").assign(raw=[bytes(r) for r in some["raw"]], width=width, cell=0, home=True)
                pivots = sent.value.get(label)
                if pivots is None or pivots.shape[1] * 8 != width:
                    yield some[["label", "width", "cell", "home", "rep", "alike", "raw"]]
                    continue
                square = np.maximum(0.0, 2.0 - 2.0 * unit(matrix(some["raw"])) @ pivots.T)
                home = square.argmin(axis=1)
                between = np.sqrt(np.maximum(2.0 - 2.0 * pivots @ pivots.T, 1e-18))
                border = (square - square[np.arange(len(some)), home][:, None]) / (2.0 * between[home])
                near = border <= radius
                near[np.arange(len(some)), home] = True
                at, cell = np.nonzero(near)
                yield some.iloc[at].assign(cell=cell, home=cell == home[at])[["label", "width", "cell", "home", "rep", "alike", "raw"]]

    placed = work.keep(classes.mapInPandas(place, "label long, width int, cell int, home boolean, rep long, alike long, raw binary"), "placed")
    blocks = work.keep(placed.groupBy("label", "width", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / float(BLOCK)).alias("_h"), F.ceil(F.sum((~F.col("home")).cast("int")) / float(BLOCK)).alias("_g")), "blocks")
    one = F.xxhash64("rep", F.lit("block"))
    spread = placed.join(blocks, ["label", "width", "cell"]).withColumn("_b", F.pmod(one, F.when(F.col("home"), F.col("_h")).otherwise(F.col("_g"))).cast("int"))
    h, g = F.col("_h").cast("int"), F.col("_g").cast("int")
    first = F.lit(0)
    with_homes = F.transform(F.sequence(first, h - 1), lambda o: F.struct(F.lit(False).alias("guests"), F.least(o, F.col("_b")).alias("i"), F.greatest(o, F.col("_b")).alias("j")))
    with_guests = F.when(g > 0, F.transform(F.sequence(first, g - 1), lambda o: F.struct(F.lit(True).alias("guests"), F.col("_b").alias("i"), o.alias("j"))))
    hosts = F.when(h > 0, F.transform(F.sequence(first, h - 1), lambda o: F.struct(F.lit(True).alias("guests"), o.alias("i"), F.col("_b").alias("j"))))
    empty = F.expr("array()").cast("array<struct<guests:boolean,i:int,j:int>>")
    pairs = F.when(F.col("home"), F.concat(with_homes, F.coalesce(with_guests, empty))).otherwise(F.coalesce(hosts, empty))
    dealt = spread.withColumn("_p", F.explode(pairs)).select("label", "width", "cell", "_p.guests", "_p.i", "_p.j", "home", F.col("_b").alias("b"), "rep", "alike", "raw")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        guests, i, j = rows["guests"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
        homes = rows[rows["home"] & (rows["b"] == i)]
        others = rows[~rows["home"]] if guests else rows[rows["home"] & (rows["b"] == j)]
        both = pd.concat([homes, others]) if guests or i != j else homes
        a, b = linked(matrix(homes["raw"]), matrix(others["raw"]), least) if len(homes) and len(others) else (np.empty(0, int), np.empty(0, int))
        ids, alike = both["rep"].to_numpy(), both["alike"].to_numpy()
        links = np.zeros(len(ids), np.int64)
        if guests or i != j:
            b = b + len(homes)
            np.add.at(links, a, alike[b])
            if not guests:
                np.add.at(links, b, alike[a])
        else:
            a, b = a[a != b], b[a != b]
            np.add.at(links, a, alike[b])
        order = np.argsort(ids, kind="stable")  # places in the order of ids, so that a root is the least id
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = np.empty(len(ids), np.int64)
        root[order] = ids[order][roots(len(ids), place[a], place[b])]
        some = (links > 0) | (root != ids)
        return pd.DataFrame({"rep": ids[some], "links": links[some], "root": root[some]})

    found = work.keep(dealt.groupBy("label", "width", "cell", "guests", "i", "j").applyInPandas(compare, "rep long, links long, root long"), "links")
    joined = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")), work)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    state = (classes.join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
             .select(F.col("label").alias("_label"), F.col("raw").alias("_raw"), (F.coalesce("links", F.lit(0)) + F.col("alike") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    members = rows.join(state, (F.col("label") == F.col("_label")) & (F.col("raw") == F.col("_raw"))).select("vec_id", "n_links", "component_id")
    counted = rows.groupBy("vec_id").agg(F.count("*").alias("_used"))
    rest = embeddings.where("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.count("*").alias("_all"))
    alone = (rest.join(counted, "vec_id", "left").withColumn("_more", F.col("_all") - F.coalesce("_used", F.lit(0))).where("_more > 0")
             .select("vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_more")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return members.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE * 100:.0f}e-2),
 r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


@query("op7_near_vectors", SQL)
def op7_near_vectors(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
