"""Steps whose groups have no bound on their rows, against plain formulas on the same rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.config import RecommendConfig
from loomspan.operators import models, ranking, signals, stats
from loomspan.plans import evaluation_plans, feature_plans
from loomspan.sources import fixtures as fx


def test_actions_at_a_threshold_follow_the_statement(spark):
    """Places i of 40 by forecast and j from the safe end by risk with 3 i + 4 j = 179 score 0.15 up to rounding, for a gate of 0.3."""
    n, pairs = 40, {13: 35, 17: 32, 21: 29, 25: 26, 29: 23, 33: 20, 37: 17}
    free = sorted(set(range(1, n + 1)) - set(pairs.values()))
    place = {i: pairs[i] if i in pairs else free.pop() for i in range(1, n + 1)}
    rows = [(dt.date(2020, 1, 2), str(i), float(i), -float(j), 0.1) for i, j in place.items()]
    df = spark.createDataFrame(rows, "Date date, Ticker string, Forecast double, Risk double, realised double")
    got = {int(r["Ticker"]): (r["action_gated"], r["action_ungated"]) for r in signals.backtest_actions(df, RecommendConfig(), 0.3).collect()}

    def action(i, j, w):
        score = (w * (2 * (i / n) - 1) + 2e-1 * (2 * (j / n) - 1)) / (w + 5e-1)
        return 1 if score >= 15e-2 else -1 if score <= -15e-2 else 0

    assert got == {i: (action(i, j, 15e-2), action(i, j, 5e-1)) for i, j in place.items()}


def ranked_rows(monkeypatch):
    """Rows that counted_ranks is given, one number a call."""
    seen, ranks = [], ranking.counted_ranks

    def counting(df, *args, **kwargs):
        seen.append(df.count())
        return ranks(df, *args, **kwargs)

    monkeypatch.setattr(ranking, "counted_ranks", counting)
    return seen


def values(spark, n):
    """Three groups of n rows and small ones: scattered values, heavy ties, one value only."""
    random.seed(5)
    rows = [("a", random.gauss(0, 1)) for _ in range(n)] + [("b", float(min(3, i % 7))) for i in range(n)] + [("c", 1.5)] * n
    rows += [("d", float(i)) for i in range(11)] + [("e", 2.0), ("e", None), ("f", None)]
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_rank_few_rows(spark, monkeypatch, by):
    rows, df = values(spark, 30_000)
    probs = {"a": 0.05, "b": 0.5, "c": 0.977, "d": 0.0, "e": 1.0}
    seen = ranked_rows(monkeypatch)
    got = ranking.quantiles(df.where("g <> 'b' AND g <> 'c'") if not by else df, by, "v", probs).collect()
    for r in got:
        held = [v for g, v in rows if v is not None and (g == r["g"] if by else g not in "bc")]
        assert [r[o] for o in probs] == pytest.approx(list(np.quantile(held, list(probs.values()))), abs=1e-12)
    assert sorted(r["g"] for r in got) == list("abcde") if by else len(got) == 1
    assert len(seen) == 1 and (by or seen[0] < 1000)


def test_a_sketch_that_misses_costs_time_only(spark, monkeypatch):
    rows, df = values(spark, 9000)
    wrong = lambda c, probs, accuracy: F.array(*[F.max(c) for _ in probs])
    seen = ranked_rows(monkeypatch)
    monkeypatch.setattr(ranking.F, "percentile_approx", wrong)
    got = ranking.quantiles(df.where("g = 'a'"), [], "v", {"m": 0.5}).head()
    assert got["m"] == pytest.approx(np.quantile([v for g, v in rows if g == "a"], 0.5), abs=1e-12) and len(seen) == 2


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert [r.asDict() for r in ranking.quantiles(df, [], "v", {"m": 0.5}).collect()] == [{"m": None}]
    assert ranking.quantiles(df, ["g"], "v", {"m": 0.5}).collect() == []


@pytest.mark.parametrize("most, ranked", [(ranking.RANGE_ROWS, 0), (20, 1)])
def test_ranks_of_measured_groups(spark, monkeypatch, most, ranked):
    """A group that is small when counted is a window; a larger one is cut into ranges with the same result."""
    random.seed(6)
    rows = [(i % 3, random.choice([None, *range(40)]), i) for i in range(900)]
    df = spark.createDataFrame([(g, None if v is None else float(v), i) for g, v, i in rows], "g int, v double, id int")
    seen = ranked_rows(monkeypatch)
    monkeypatch.setattr(ranking, "RANGE_ROWS", most)
    got = {r["id"]: r["p"] for r in ranking.rank_pct(df, ["g"], "v", "p", ranges=8).collect()}
    for g, v, i in rows:
        held = [x for h, x, _ in rows if h == g and x is not None]
        want = None if v is None else (sum(x < v for x in held) + (held.count(v) + 1) / 2) / len(held)
        assert got[i] == (want if want is None else pytest.approx(want, abs=1e-12))
    assert len(seen) == ranked


def test_month_sketches_and_tails_take_the_panel_apart_once(spark, sf, monkeypatch):
    panel = fx.wide_bars(spark, sf).toPandas()
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    given = spark.createDataFrame(panel).select("Date", "Ticker", F.col("AdjClose"))
    monkeypatch.setattr(feature_plans.fx, "wide_bars", lambda *_: given.mapInPandas(count, given.schema))
    feature_plans.month_sketches(spark, sf).count()
    assert read.value == len(panel)
    read.value = 0
    stats.var_cvar(stats.log_returns(feature_plans.fx.wide_bars()), []).collect()
    assert read.value == len(panel)


def test_model_rows_take_the_lines_apart_once(spark, sf, monkeypatch):
    """Split, scales and rows of the fits, and every part of the model table, come from one pass over the bars."""
    panel = fx.bars(spark, sf).toPandas()
    read, base = spark.sparkContext.accumulator(0), spark.createDataFrame(panel)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    monkeypatch.setattr(fx, "bars", lambda *_: base.mapInPandas(count, base.schema))
    rows = evaluation_plans.model_rows(spark, sf)
    models.standard_scale(rows, evaluation_plans.MODEL_COLS, F.col("Split") == "train").collect()
    assert read.value == len(panel)
    read.value = 0
    feature_plans.model_table(spark, sf).count()
    assert read.value == len(panel)
