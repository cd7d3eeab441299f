"""Features of arriving bars from state per series, equal to the batch families over the whole history.

A series keeps its running averages, its peak, the return pairs of the beta window and the bars that wait for the watermark; an
event-time timer takes the waiting bars in the order of their dates. State may begin from a batch table, so that history is not
streamed again. State of a series is bounded by the beta window and the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspan.config import EngineConfig, FeatureConfig
from loomspan.functions.ema import with_ema
from loomspan.operators.context import rolling_beta

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RUNNING = "session long, price double, averages array<double>, signal double, peak double"
PAIRS = "session long, r double, m double"
BAR = "at long, session long, price double, m double, m_var double"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that arbitrary state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _spans(cfg: FeatureConfig) -> list[int]:
    return sorted({*cfg.ema_windows, *cfg.macd[:2]})


def columns(cfg: FeatureConfig) -> list[str]:
    return [*(f"EMA_{w}" for w in cfg.ema_windows), "MACD", "MACD_Signal", "MACD_Hist", "Drawdown_From_Peak", "Beta"]


class SeriesProcessor(StatefulProcessor):
    """Averages, drawdown and beta of one series, a bar at a time."""

    def __init__(self, cfg: EngineConfig):
        self.cfg, self.spans = cfg, _spans(cfg.features)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", RUNNING)
        self.pairs = handle.getListState("pairs", PAIRS)
        self.waiting = handle.getListState("waiting", BAR)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self.running.update((int(row.session), float(row.price), [float(a) for a in row.averages], float(row.signal), float(row.peak)))
            if len(row.pairs):
                self.pairs.put([(int(p["session"]), float(p["r"]), float(p["m"])) for p in row.pairs])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Bars wait for the watermark; a repeated date counts once. Bars without a price only carry the event time."""
        waiting = {b[0]: b for b in self.waiting.get()}
        for part in rows:
            part = part[part["price"].notna() & part["session"].notna()]
            at = part["Date"].astype("datetime64[ms]").astype("int64")
            for t, session, price, m, m_var in zip(at, part["session"], part["price"], part["m"], part["m_var"], strict=True):
                waiting.setdefault(int(t), (int(t), int(session), float(price), *(None if pd.isna(x) else float(x) for x in (m, m_var))))
        if waiting:
            self.handle.registerTimer(min(waiting))
            self.waiting.put(list(waiting.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The timer of the earliest bar takes all that the watermark has passed; the next bar left gets the next timer."""
        upto, waiting = timerValues.getCurrentWatermarkInMs(), sorted(self.waiting.get())
        due = [b for b in waiting if b[0] <= upto]
        if not due:
            return
        left = waiting[len(due):]
        if left:
            self.handle.registerTimer(left[0][0])
            self.waiting.put(left)
        else:
            self.waiting.clear()
        now = self.running.get() if self.running.exists() else None
        pairs = [tuple(p) for p in self.pairs.get()]
        out = []
        for at, session, price, m, m_var in due:
            if now is not None and session <= now[0]:
                continue  # a repeat of a bar that is in the state already
            now, pairs, values = self.step(now, pairs, session, price, m, m_var)
            out.append((pd.Timestamp(at, unit="ms"), key[0], *values))
        if not out:
            return
        self.running.update(now)
        self.pairs.put(pairs) if pairs else self.pairs.clear()
        yield pd.DataFrame(out, columns=["Date", "Ticker", *columns(self.cfg.features)])

    def step(self, now, pairs, session, price, m, m_var):
        """State and output values after one bar."""
        fast, slow, signal_span = self.cfg.features.macd
        if now is None:
            averages, peak, r = [price] * len(self.spans), price, None
        else:
            averages = [a + 2.0 / (w + 1.0) * (price - a) for a, w in zip(now[2], self.spans, strict=True)]
            peak = max(now[4], price)
            r = float(np.log(price) - np.log(now[1])) if session == now[0] + 1 else None
        of = dict(zip(self.spans, averages, strict=True))
        macd = of[fast] - of[slow]
        signal = macd if now is None else now[3] + 2.0 / (signal_span + 1.0) * (macd - now[3])
        if r is not None and m is not None:
            pairs = [*pairs, (session, r, m)]
        pairs = [p for p in pairs if p[0] > session - self.cfg.beta_window]
        beta = None
        if len(pairs) >= self.cfg.beta_min_periods and m_var:
            x = np.array([p[1:] for p in pairs])
            beta = float(((x[:, 0] - x[:, 0].mean()) * (x[:, 1] - x[:, 1].mean())).sum() / (len(x) - 1) / m_var)
        values = [*(of[w] for w in self.cfg.features.ema_windows), macd, signal, macd - signal, price / peak - 1.0 if peak else None, beta]
        return (session, price, averages, signal, peak), pairs, values

    def close(self) -> None:
        pass


def series_state(panel: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The state of every universe series after the last of its bars in a batch panel, one row each."""
    fast, slow, signal = cfg.features.macd
    mine = panel.where(F.col("Ticker").isin(list(cfg.universe))).select("Date", "Ticker", "AdjClose")
    wanted = {f"_e{w}": (F.col("AdjClose"), w) for w in _spans(cfg.features)}
    averages = with_ema(mine, wanted, {"_macd": F.col(f"_e{fast}") - F.col(f"_e{slow}")}, {"_signal": (F.col("_macd"), signal)})
    returns = rolling_beta(panel, cfg).select("Date", "Ticker", "SIdx", "r", "m")
    rows = averages.join(returns, ["Date", "Ticker"])
    at_end = F.max_by(F.struct(F.col("SIdx").cast("long").alias("session"), F.col("AdjClose").alias("price"),
                               F.array(*wanted).alias("averages"), F.col("_signal").alias("signal")), "SIdx")
    last = rows.groupBy("Ticker").agg(at_end.alias("_s"), F.max("AdjClose").alias("peak"))
    recent = (
        rows.join(last.select("Ticker", F.col("_s.session").alias("_end")), "Ticker")
        .where((F.col("SIdx") > F.col("_end") - cfg.beta_window) & (F.col("r") + F.col("m")).isNotNull())
        .groupBy("Ticker").agg(F.array_sort(F.collect_list(F.struct(F.col("SIdx").cast("long").alias("session"), "r", "m"))).alias("pairs"))  # a beta window at most
    )
    held = last.join(recent, "Ticker", "left").select("Ticker", "_s.*", "peak", "pairs")
    return held.withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<session:bigint,r:double,m:double>>")))


def stream_features(bars: DataFrame, calendar: DataFrame, market: DataFrame, cfg: EngineConfig, delay: str = "3 days",
                    initial: DataFrame | None = None) -> DataFrame:
    """Date, Ticker and columns() of a stream of bars (Date, Ticker, AdjClose), each once the watermark has passed its date.

    calendar (Date, Session) and market (Date, m, m_var; see context.market_returns) are static, one row per session; both must reach beyond the stream.
    Bars on dates that are no session are left out, as are series outside the universe; a bar without a price moves the
    event time alone. initial has rows of series_state, from which the series go on.
    """
    timed = bars.withColumn("Date", F.col("Date").cast("timestamp")).withWatermark("Date", delay)
    day = F.to_date("Date")
    rows = (
        timed.where(F.col("Ticker").isin(list(cfg.universe)) | F.col("AdjClose").isNull())
        .join(F.broadcast(calendar.select(F.col("Date").alias("_day"), F.col("Session").cast("long").alias("session"))), day == F.col("_day"), "left").drop("_day")
        .join(F.broadcast(market.select(F.col("Date").alias("_day"), "m", "m_var")), day == F.col("_day"), "left").drop("_day")
        .select("Date", "Ticker", F.col("AdjClose").alias("price"), "session", "m", "m_var")
    )
    schema = ", ".join(["Date timestamp", "Ticker string", *(f"{c} double" for c in columns(cfg.features))])
    out = rows.groupBy("Ticker").transformWithStateInPandas(
        SeriesProcessor(cfg), outputStructType=schema, outputMode="Append", timeMode="EventTime",
        initialState=None if initial is None else initial.groupBy("Ticker"))
    return out.withColumn("Date", F.to_date("Date"))

