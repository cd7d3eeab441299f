"""Connected components of a graph given as edges, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.work import Work


def components(edges: DataFrame, work: Work, label: str = "components") -> DataFrame:
    """node and root (the least node reachable, itself included) of every node in edges (a, b).

    In each round a node takes the least label among its neighbours' and its own, then the label of its label. Both steps
    are a join and a minimum with a map-side part, so a node with any number of edges is no problem. Labels are written
    after each round; only the number of changed labels reaches the driver. No edges give no rows.
    """
    both = work.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), f"{label}-edges")
    labels = work.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{label}-0")
    done = 0
    while True:
        done += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        stepped = lower.join(jump, F.col("root") == F.col("to")).select("node", "before", F.least("root", "beyond").alias("root"))
        held = work.keep(stepped, f"{label}-{done}")
        changed = held.where("root != before").limit(1).count()
        labels = held.select("node", "root")
        if not changed:
            return labels
