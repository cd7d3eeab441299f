"""Mixing: targets against a step-by-step rule, bounds, repeatability, odd rows."""

import random

from pyspark.sql import functions as F

from loomspan.llm import mixing


def brute_targets(totals, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted([n for n in totals if n is not None], key=lambda n: n.encode()) + [n for n in totals if n is None]
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(totals.values())
    while True:
        level = rest / sum(w[n] for n in open_) if open_ else 0
        over = {n for n in open_ if w[n] * level > cap * totals[n]}
        if not over:
            return target | {n: w[n] * level for n in open_}
        for n in over:
            target[n] = cap * totals[n]
            rest -= target[n]
        open_ -= over


def test_targets_match_the_stepwise_rule(spark):
    random.seed(3)
    for _ in range(4):
        totals = {n: random.choice([0, 5, 100, 1000, 40_000]) for n in ["b", "a", "é", "Z", "aa", None][: random.randint(1, 6)]}
        df = spark.createDataFrame([(n, t) for n, t in totals.items()], "source string, _total long")
        got = {r["source"]: r["_target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(totals)
        assert got.keys() == want.keys()
        for n in want:
            assert abs(got[n] - want[n]) < 1e-6 * max(1, want[n])


def test_taken_words(spark):
    random.seed(4)
    rows = [(i, " ".join(["w"] * min(int(random.paretovariate(1.1) * 20), 3000)), random.choice(["hot", "hot", "hot", "b", "c"]), "x", 7) for i in range(3000)]
    rows += [(5, None, "b", "x", 7), (6, "", None, "x", 7), (6, "", None, "x", 7), (None, "one two", None, "x", 7), (9, " \t\x0b\x0c\r\n", "b", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int")  # clashing names
    counted = mixing.with_copies(docs).select("_row.doc_id", "_row.source", "_size", "_total", "_target", "_copies").collect()
    assert len(counted) == len(rows)
    again = mixing.with_copies(docs.repartition(7)).select("_row.doc_id", "_row.source", "_size", "_total", "_target", "_copies").collect()
    assert sorted(map(str, counted)) == sorted(map(str, again))
    assert all(r["_size"] * r["_copies"] <= 2 * r["_size"] for r in counted)
    for source in ("hot", "b", "c"):
        some = [r for r in counted if r["source"] == source]
        taken = sum(r["_size"] * r["_copies"] for r in some)
        assert abs(taken - some[0]["_target"]) <= max(0.05 * some[0]["_target"], 3000)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["_copies"] for r in counted)
    assert out.where(F.col("target") != 7).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.with_copies(empty).count() == 0 and mixing.mix(empty).count() == 0
