"""Registered queries: features of arriving bars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators import context
from loomspan.plans.cleaning_plans import KEYS
from loomspan.plans.feature_plans import CFG, EVER, XS, _ema_cte
from loomspan.plans.registry import g, publish, query
from loomspan.session import materialise, run_dir
from loomspan.sources import fixtures as fx
from loomspan.streaming import features as stream_features
from loomspan.streaming import streams

ARRIVALS = 3


def arriving_bars(spark, panel, cfg):
    """(history, stream, arrivals): the first half of the sessions as a table; the rest arrives by thirds, out of order within each.

    With the last third comes a bar without a price, ten days on, so that the watermark passes all others.
    """
    days = context.sessions(panel)
    n = days.count()
    half = n // 2
    size = max(1, -(-(n - half) // ARRIVALS))
    part = F.when(F.col("SIdx") < half, -1).otherwise(F.floor((F.col("SIdx") - half) / size)).cast("int")
    parts = run_dir(spark, "stream-feature-parts")
    panel.join(days, "Date").withColumn("_part", part).drop("SIdx").repartition(4, F.xxhash64("Date")).write.partitionBy("_part").parquet(parts)
    held = spark.read.schema(T.StructType([*panel.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(parts)
    bars = held.select("Date", "Ticker", "AdjClose", "_part")
    path = run_dir(spark, "stream-feature-in")
    arriving = bars.drop("_part")
    arriving.limit(0).write.parquet(path)
    clock = bars.groupBy().agg(F.date_add(F.max("Date"), 10).alias("Date")).select("Date", F.lit(cfg.universe[0]).alias("Ticker"), F.lit(None).cast("double").alias("AdjClose"))

    def arrival(number):
        def arrive():
            mine = bars.where(F.col("_part") == number).drop("_part")
            (mine.unionByName(clock) if number == ARRIVALS - 1 else mine).write.mode("append").parquet(path)
        return arrive

    stream = streams.read_file_stream(spark, path, arriving.schema, None)  # a micro-batch takes what has arrived
    return held.where("_part = -1").drop("_part"), stream, [arrival(k) for k in range(ARRIVALS)]


@query("stream_features", XS + f""", v0 AS (SELECT * FROM fx_bars WHERE Ticker IN ('AF', 'AO', 'NF', 'RF')),
 {_ema_cte('e', 'v0', 'AdjClose', {'f': 12, 's': 26})}, {_ema_cte('sg', 'e', 'f - s', {'sig': 9})},
 dr AS (SELECT Date, Ticker, AdjClose / max(AdjClose) OVER {EVER} - 1 AS Drawdown FROM v0)
 SELECT e.Date, e.Ticker, {g('f')} AS EMA_12, {g('s')} AS EMA_26, {g('f - s')} AS MACD, {g('sig')} AS MACD_Signal, {g('f - s - sig')} AS MACD_Hist,
  {g('Drawdown')} AS Drawdown_From_Peak, {g('Beta')} AS Beta
 FROM e JOIN sg USING (Date, Ticker) JOIN dr USING (Date, Ticker) JOIN bt USING (Date, Ticker) WHERE si >= (SELECT count(*) FROM dd) // 2""")
def _(spark, sf):
    """State begins from the first half of the sessions; the rest streams in, over three starts of the query."""
    panel = materialise(fx.bars(spark, sf), "stream-feature-panel")
    history, bars, arrivals = arriving_bars(spark, panel, CFG)
    calendar = context.sessions(panel).select("Date", F.col("SIdx").alias("Session"))
    with stream_features.keyed_state(spark):
        out = streams.drain(stream_features.stream_features(bars, calendar, context.market_returns(panel, CFG), CFG, initial=stream_features.series_state(history, CFG)),
                            "stream-features", arrivals)
    return publish(out, KEYS, stream_features.columns(CFG.features))
