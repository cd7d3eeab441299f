"""What the actions over many series move and keep on disk, and that carried signals equal joined ones."""

import datetime as dt
import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.operators import ranking, signals
from loomspan.plans import evaluation_plans
from loomspan.plans.registry import REGISTRY
from loomspan.session import FREE_SHUFFLES, materialise
from loomspan.sources import fixtures as fx

ACTIONS = ("action_buy_and_hold", "action_gated", "action_ungated")


def panel(spark, days=160, names=9):
    """Series with gaps, equal prices, and rows without a price, a date or a name."""
    random.seed(11)
    start, rows = dt.date(2020, 1, 1), []
    for name in [*map(str, range(names)), None]:
        price = 100.0
        for k in range(days):
            price *= math.exp(random.choice([0.0, 0.01, -0.01, random.gauss(0, 0.02)]))
            if random.random() < 0.05:
                continue
            rows.append((start + dt.timedelta(k), name, random.choice([None, math.nan, 0.0]) if random.random() < 0.004 else price))
    rows += [(None, str(i), 90.0 + i) for i in range(names)]
    return spark.createDataFrame(rows, "Date date, Ticker string, AdjClose double")


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


@pytest.mark.parametrize("bound", [ranking.WINDOW_BOUND, 5])
def test_carried_signals_equal_joined_ones(spark, monkeypatch, bound):
    """Within the bound and beyond it, where the ranks are taken without a window per date."""
    bars = panel(spark)
    rev = "Model = 'rev'"
    joined = signals.signal_outcome(fx.predictions_over(bars).where(rev), signals.trailing_risk(bars), signals.forward_outcome(bars))
    want = sorted(map(tuple, joined.collect()))
    monkeypatch.setattr(evaluation_plans.fx, "wide_bars", lambda *_: bars)
    for module in (signals, ranking):
        monkeypatch.setattr(module, "WINDOW_BOUND", bound)
    seen, act = [], signals.backtest_actions
    monkeypatch.setattr(signals, "backtest_actions", lambda rows, *a: seen.append(rows) or act(rows, *a))
    got = REGISTRY["backtest_actions_many"].run(spark, "")
    assert sorted(map(tuple, seen[0].select(*joined.columns).collect())) == want and len(want) > 200
    plain = act(joined, evaluation_plans.CFG.recommend, 0.3).select("Date", "Ticker", *ACTIONS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert {r["action_ungated"] for r in got.collect()} == {-1, 0, 1}


def test_bars_of_many_series_are_taken_apart_once_and_moved_twice(spark, sf, monkeypatch):
    bars = fx.wide_bars(spark, sf).toPandas()
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    given = spark.createDataFrame(bars)
    monkeypatch.setattr(evaluation_plans.fx, "wide_bars", lambda *_: given.mapInPandas(count, given.schema))
    got = REGISTRY["backtest_actions_many"].run(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() > 0 and read.value == len(bars)
    assert plan.count("Exchange ") == 2 and "Join" not in plan


def test_a_lean_write_leaves_no_shuffle_files(spark):
    before, set_before = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES, None)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 997).groupBy("k").agg(F.sum("id").alias("s"))
    kept = materialise(rows, "lean", lean=True)
    until = time.time() + 30  # files go in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(FREE_SHUFFLES, None) == set_before
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect())) and kept.schema == rows.schema


def test_first_and_last_price_come_from_the_order(spark, tmp_path):
    """Rows in odd order, twice, with missing keys and prices; an absent part of the order comes first."""
    day = dt.datetime(2020, 1, 2)
    rows = [(o, 1, 1, 7, n, p, d, 1.0, "A", "F", day) for o, n, p, d in (
        (5, 1, 30.0, 0.1), (2, 2, 20.0, 0.0), (2, 1, 10.0, 0.2), (9, 1, None, 0.1), (9, 1, None, 0.1), (None, 1, 40.0, 0.3))]
    rows += [(o, 1, 1, 8, 1, p, 0.5, 1.0, "A", "F", day) for o, p in ((3, 2.0), (1, 4.0), (3, 2.0), (3, 1.0))]
    names = "l_orderkey l_partkey x l_suppkey l_linenumber l_extendedprice l_discount l_quantity l_returnflag l_linestatus l_shipdate".split()
    pd.DataFrame(rows, columns=names).astype({"l_orderkey": "Int64"}).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    got = {r["Ticker"]: r for r in fx.wide_bars(spark, str(tmp_path)).collect()}
    assert (got["7"]["Open"], got["7"]["Close"], got["7"]["AdjClose"], got["7"]["High"], got["7"]["Low"]) == (0.04, None, None, 0.04, 0.01)
    assert (got["8"]["Open"], got["8"]["Close"], got["8"]["AdjClose"]) == (0.004, 0.002, 0.001)
