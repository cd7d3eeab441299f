"""Features of arriving bars against the batch families: with and without a beginning state, repeats, gaps, restarts."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.config import EngineConfig
from loomspan.operators import context, features
from loomspan.session import run_dir
from loomspan.streaming import features as stream_features
from loomspan.streaming import streams

CFG = EngineConfig(universe=("A", "B", "C"), benchmark="M", beta_window=20, beta_min_periods=6)
SESSIONS = 70


def panel_rows():
    random.seed(6)
    days = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(120)) if d.weekday() < 5][:SESSIONS]
    rows, price = [], dict.fromkeys("ABCM", 100.0)
    for i, day in enumerate(days):
        for t in "ABCM":
            price[t] *= math.exp(random.gauss(0, 0.02))
            if t == "B" and i % 9 == 4 or t == "C" and i < 40:  # gaps, and a series that begins late
                continue
            rows.append((day, t, price[t]))
    return rows, days


@pytest.mark.parametrize("begin", [0, 30])
def test_equal_to_the_batch(spark, begin):
    rows, days = panel_rows()
    schema = "Date date, Ticker string, AdjClose double"
    panel = spark.createDataFrame(rows, schema)
    wide = panel.select("*", *[F.col("AdjClose").alias(c) for c in ("Open", "High", "Low", "Close")], F.lit(1.0).alias("Volume"))
    path = run_dir(spark, "test-stream-features")
    spark.createDataFrame([], schema).write.parquet(path)
    cuts = [begin, begin + 13, begin + 14, SESSIONS]

    def arrival(k):
        def arrive():
            mine = [r for r in rows if days[cuts[k]] <= r[0] and (k == 2 or r[0] < days[cuts[k + 1]])]
            repeats = [(d, t, p * 2) for d, t, p in rows if days[max(0, cuts[k] - 2)] <= d < days[cuts[k]]] if k else []  # these came before
            beyond = [(days[-1] + dt.timedelta(days=10), "A", None), (dt.date(2024, 1, 6), "A", 5.0)] if k == 2 else []
            # repeats of bars that were given out are in a file of their own, behind the watermark or behind the state
            for part in (mine[::-1], repeats + beyond):
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        return arrive

    stream = streams.read_file_stream(spark, path, panel.schema, None)
    calendar = context.sessions(panel).select("Date", F.col("SIdx").alias("Session"))
    history = panel.where(F.col("Date") < F.lit(days[begin])) if begin else None
    with stream_features.keyed_state(spark):
        out = stream_features.stream_features(stream, calendar, context.market_returns(panel, CFG), CFG, "1 day", None if history is None else stream_features.series_state(history, CFG))
        got = {(r.Date, r.Ticker): r for r in streams.drain(out, "test-stream-features", [arrival(k) for k in range(3)]).collect()}

    names = stream_features.columns(CFG.features)
    batch = features.series_features(wide.where("Ticker != 'M'"), only=["ema", "macd", "drawdown_state"]).join(context.rolling_beta(panel, CFG).select("Date", "Ticker", "Beta"), ["Date", "Ticker"])
    want = {(r.Date, r.Ticker): r for r in batch.where(F.col("Date") >= F.lit(days[begin])).collect()}
    assert set(got) == set(want) and len(want) > 60
    for key, r in want.items():
        for c in names:
            assert (got[key][c] is None) == (r[c] is None), (key, c)
            assert r[c] is None or abs(got[key][c] - r[c]) <= 1e-9 * max(1.0, abs(r[c])), (key, c, got[key][c], r[c])
    assert any(r.Beta is not None for r in want.values())
