"""Per-series trailing features.

Every family is a set of window expressions over the same (Ticker, Date) order. They are put into
levels (lags, windows, windows over windows, row expressions), so the whole table costs one exchange by
series and no further sort; columns nobody selects are pruned by the optimizer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import EngineConfig, FeatureConfig
from loomspan.functions.ema import with_ema
from loomspan.functions.expr import by_series, clip, div, finite, root, trailing

YEAR = math.sqrt(252.0)

# Columns that are never model inputs.
NON_FEATURES = frozenset({
    "Date", "Ticker", "Target", "Target_Price", "Relative_Target", "Rank_Target",
    "Open", "High", "Low", "Close", "AdjClose", "Volume", "Outlier_IQR", "Outlier",
})


def families(cfg: FeatureConfig = FeatureConfig()) -> dict[str, list[str]]:
    """Output columns per family."""
    return {
        "log_returns": [f"Return_{w}d" for w in cfg.return_windows],
        "reversal": ["Return_Reversal_2d", "Return_Reversal_5d"],
        "overnight_intraday": ["Overnight_Return", "Intraday_Return", "Overnight_Gap_3d"],
        "sma": [f"{p}SMA_{w}" for w in cfg.sma_windows for p in ("", "Price_to_")],
        "ema": [f"EMA_{w}" for w in cfg.ema_windows],
        "macd": ["MACD", "MACD_Signal", "MACD_Hist"],
        "rsi": [f"RSI_{cfg.rsi_period}"],
        "stochastic": ["Stoch_K", "Stoch_D"],
        "roc": [f"ROC_{w}" for w in cfg.roc_windows],
        "rolling_vol": [f"Vol_{w}d" for w in cfg.vol_windows],
        "atr": [f"ATR_{cfg.atr_period}"],
        "bollinger_width": ["BB_Width"],
        "range_vols": ["Vol_Parkinson", "Vol_GarmanKlass", "Vol_RogersSatchell"],
        "vol_of_vol": ["Vol_Of_Vol", "Vol_Ratio_Short_Long"],
        "drawdown_state": ["Drawdown_From_Peak", "Distance_From_52w_High", "Position_In_52w_Range"],
        "efficiency_ratio": ["Efficiency_Ratio_21", "Efficiency_Ratio_63"],
        "volume_z": ["Volume_Z", "Volume_Change", "Volume_MA_20", "Volume_MA_Ratio", "Relative_Volume_21"],
        "obv": ["OBV", "OBV_Z"],
        "volume_price_div": ["Volume_Price_Div"],
        "signed_volume_flow": ["Signed_Volume_Flow"],
        "amihud": ["Amihud_Illiquidity", "Log_Dollar_Volume"],
        "calendar_feats": ["DayOfWeek", "Month", "TurnOfMonth"],
        "lags": [f"{p}_Lag_{k}" for k in cfg.lags for p in ("Close", "Return")],
    }


WIDE = 100


def _split(w: int) -> tuple[int, int]:
    """w = m * k with m close to sqrt(w)."""
    k = max(d for d in range(1, math.isqrt(w) + 1) if w % d == 0)
    return w // k, k


class _Levels:
    """Window columns by nesting level, each registered once under a name and then referred to by it.

    Spark evaluates a window expression as often as it is written, so a shared lag or frame must be one
    column. A sliding frame costs one update per row it holds: very wide frames (WIDE rows and more) are
    built from parts of about sqrt(w) rows that are merged through lags. "w non-null values" is tested
    by the length of the current run of non-null rows, a running window shared by all widths of a column.
    """

    def __init__(self) -> None:
        self.windows: list[dict[str, Column]] = [{}, {}, {}, {}]
        self.rows: list[list[dict[str, Column]]] = [[], [], [], []]
        self.sums: dict[str, Column] = {}
        self.order = by_series()

    def window(self, level: int, key: str, column: Column) -> Column:
        self.windows[level].setdefault(key, column)
        return F.col(key)

    def lag(self, level: int, name: str, k: int) -> Column:
        return self.window(level, f"_{name}_lag{k}", F.lag(name, k).over(self.order))

    def run(self, level: int, name: str) -> Column:
        """Number of consecutive non-null rows of column `name` that end here."""
        ever = self.order.rowsBetween(Window.unboundedPreceding, 0)
        last_null = self.window(level, f"_null_{name}", F.max(F.when(F.col(name).isNull(), F.col("_pos"))).over(ever))
        return F.col("_pos") - F.coalesce(last_null, F.lit(-1))

    def rolling(self, level: int, kind: str, name: str, w: int) -> Column:
        """Unguarded trailing sum, max or min over w rows."""
        agg, merge = {"sum": (F.sum, lambda cs: sum(cs[1:], cs[0])), "max": (F.max, lambda cs: F.greatest(*cs)),
                      "min": (F.min, lambda cs: F.least(*cs))}[kind]
        m, k = _split(w) if w >= WIDE else (w, 1)
        key = f"_{kind}{m}_{name}"
        first = self.window(level, key, agg(name).over(trailing(m, self.order)))
        return merge([first, *[self.lag(level + 1, key, j * m) for j in range(1, k)]]) if k > 1 else first

    def total(self, level: int, name: str, w: int) -> Column:
        return F.when(self.run(level, name) >= w, self.rolling(level, "sum", name, w))

    def mean(self, level: int, name: str, w: int) -> Column:
        return self.total(level, name, w) / float(w)

    def extreme(self, level: int, kind: str, name: str, w: int) -> Column:
        return F.when(self.run(level, name) >= w, self.rolling(level, kind, name, w))

    def deviation(self, level: int, name: str, w: int) -> Column:
        sd = self.window(level, f"_sd{w}_{name}", F.stddev_samp(name).over(trailing(w, self.order)))
        return F.when(self.run(level, name) >= w, sd)

    def return_deviation(self, w: int) -> Column:
        """Sample deviation of the daily returns from sums and sums of squares over parts of 7 rows or less.

        Returns scatter around zero, so the difference of squares loses no precision; a remainder at
        rounding level counts as zero. The result is a level-2 row column.
        """
        m = max((d for d in range(2, 8) if w % d == 0), default=w)
        s, q = (sum((self.lag(2, part, j) for j in range(m, w, m)), F.col(part)) for part in (
            self.window_name(1, f"_sum{m}_{x}", F.sum(x).over(trailing(m, self.order))) for x in ("_r", "_r2")))
        self.sums |= {f"_s{w}": s, f"_q{w}": q}
        rest = F.col(f"_q{w}") - F.col(f"_s{w}") * F.col(f"_s{w}") / float(w)
        sd = F.when(rest > F.col(f"_q{w}") * 1e-13, F.sqrt(rest / float(w - 1))).otherwise(0.0)
        return F.when(self.run(1, "_r") >= w, sd)

    def window_name(self, level: int, key: str, column: Column) -> str:
        self.window(level, key, column)
        return key

    def apply(self, df: DataFrame) -> DataFrame:
        for windows, rows in zip(self.windows, self.rows):
            df = df.withColumns(windows) if windows else df
            for batch in rows:
                df = df.withColumns(batch)
        return df


def _levels(cfg: FeatureConfig) -> _Levels:
    """Level 0: lags of the panel. 1: frames over those. 2: lags of parts. 3: frames over level 2."""
    lv = _Levels()
    w = lv.order
    ever = w.rowsBetween(Window.unboundedPreceding, 0)
    p, o, c, v = F.col("AdjClose"), F.col("Open"), F.col("Close"), F.col("Volume")
    hi, lo = F.col("High"), F.col("Low")

    def back(name: str, k: int = 1) -> Column:
        return lv.lag(0, name, k)

    lv.window(0, "_pos", F.row_number().over(w) - 1)
    before = lv.window(0, "_month_before", F.lag("_month", cfg.month_edge).over(w))
    after = lv.window(0, "_month_after", F.lead("_month", cfg.month_edge).over(w))
    month = F.col("_month")
    first = {f"Return_{k}d": F.col("_lp") - back("_lp", k) for k in cfg.return_windows} | {
        "_r": F.col("_lp") - back("_lp"), "_r2": F.pow(F.col("_lp") - back("_lp"), 2.0),
        "_gain": clip(p - back("AdjClose"), lo=0.0), "_loss": clip(back("AdjClose") - p, lo=0.0),
        "_step": F.abs(p - back("AdjClose")),
        "_flow": F.signum(div(c, back("Close")) - 1) * v * F.abs(div(c, back("Close")) - 1),
        "_impact": div(F.abs(div(c, back("Close")) - 1), c * v),
        "_signed": F.signum(F.coalesce(c - back("Close"), F.lit(0.0))) * v,
        "_net21": F.abs(p - back("AdjClose", 21)), "_net63": F.abs(p - back("AdjClose", 63)),
        "_tr": F.greatest(F.abs(hi - lo), F.abs(hi - back("Close")), F.abs(lo - back("Close"))),
        "_hl2": F.pow(F.ln(div(hi, lo)), 2.0),
        "_gk": 0.5 * F.pow(F.ln(div(hi, lo)), 2.0) - (2.0 * math.log(2.0) - 1.0) * F.pow(F.ln(div(c, o)), 2.0),
        "_rs": F.ln(div(hi, c)) * F.ln(div(hi, o)) + F.ln(div(lo, c)) * F.ln(div(lo, o)),
        "Return_Reversal_5d": back("_lp", 5) - F.col("_lp"),
        "Overnight_Return": F.ln(div(o, back("Close"))),
        "Intraday_Return": F.ln(div(c, o)),
        "Overnight_Gap_3d": F.ln(div(o, back("Close", 3))),
        "Volume_Change": div(v, back("Volume")) - 1,
        "Log_Dollar_Volume": F.log1p(c * v),
        "DayOfWeek": F.weekday("Date"), "Month": F.month("Date"),
        "TurnOfMonth": (~F.coalesce(before == month, F.lit(False)) | ~F.coalesce(after == month, F.lit(False))).cast("int"),
    }
    first |= {f"ROC_{k}": (div(p, back("AdjClose", k)) - 1) * 100.0 for k in cfg.roc_windows}
    first |= {f"Close_Lag_{k}": back("AdjClose", k) for k in cfg.lags}
    lv.rows[0] = [first]

    peak = lv.window(1, "_peak", F.max(p).over(ever))
    lv.window(1, "OBV", F.sum("_signed").over(ever))
    kp, dp = cfg.stochastic
    low, high = lv.extreme(1, "min", "Low", kp), lv.extreme(1, "max", "High", kp)
    lv.rows[1] = [{"Stoch_K": 100.0 * div(c - low, high - low)}
                  | {f"Return_Lag_{j}": lv.lag(1, "_r", j) for j in cfg.lags}]

    vz, (bw, bk), rp = cfg.volume_z_window, cfg.bollinger, cfg.rsi_period
    second = {f"_sd{n}": lv.return_deviation(n) for n in sorted({*cfg.vol_windows, 10, 20, 21, 63})}
    second |= {f"SMA_{n}": lv.mean(1, "AdjClose", n) for n in cfg.sma_windows}
    year_hi = lv.extreme(1, "max", "AdjClose", cfg.year_window)
    year_lo = lv.extreme(1, "min", "AdjClose", cfg.year_window)
    second |= {"_year_hi": year_hi, "_year_lo": year_lo}
    lv.rows[2] = [lv.sums, second]

    lv.window(3, "_mean_obv", F.avg("OBV").over(trailing(cfg.obv_window, w)))
    lv.window(3, "_dev_obv", F.stddev_samp("OBV").over(trailing(cfg.obv_window, w)))
    z = F.when(lv.run(3, "OBV") >= cfg.obv_window, div(F.col("OBV") - F.col("_mean_obv"), F.col("_dev_obv")))
    v_mean = lv.mean(1, "Volume", vz)
    hi52, lo52 = F.col("_year_hi"), F.col("_year_lo")
    last = {
        "OBV_Z": z,
        "Stoch_D": lv.mean(3, "Stoch_K", dp),
        "Vol_Of_Vol": lv.deviation(3, "_sd21", 63) * YEAR,
        "Return_Reversal_2d": -lv.total(1, "_r", 2),
        f"RSI_{rp}": 100.0 - 100.0 / (1.0 + div(lv.total(1, "_gain", rp), lv.total(1, "_loss", rp))),
        f"ATR_{cfg.atr_period}": div(lv.mean(1, "_tr", cfg.atr_period), c),
        "BB_Width": div(2.0 * bk * lv.deviation(1, "AdjClose", bw), lv.mean(1, "AdjClose", bw)),
        "Vol_Parkinson": root(lv.mean(1, "_hl2", 21) / (4.0 * math.log(2.0)) * 252.0),
        "Vol_GarmanKlass": root(lv.mean(1, "_gk", 21) * 252.0),
        "Vol_RogersSatchell": root(lv.mean(1, "_rs", 21) * 252.0),
        "Vol_Ratio_Short_Long": div(F.col("_sd10"), F.col("_sd63")),
        "Drawdown_From_Peak": div(p, peak) - 1.0,
        "Distance_From_52w_High": div(p, hi52) - 1.0,
        "Position_In_52w_Range": clip(div(p - lo52, hi52 - lo52), -0.5, 1.5),
        "Efficiency_Ratio_21": clip(div(F.col("_net21"), lv.total(1, "_step", 21)), 0.0, 1.0),
        "Efficiency_Ratio_63": clip(div(F.col("_net63"), lv.total(1, "_step", 63)), 0.0, 1.0),
        "Volume_Z": div(v - v_mean, lv.deviation(1, "Volume", vz)),
        "Volume_MA_20": lv.mean(1, "Volume", 20), "Volume_MA_Ratio": div(v, lv.mean(1, "Volume", 20)),
        "Relative_Volume_21": div(v, lv.mean(1, "Volume", 21)),
        "Volume_Price_Div": z - div(F.col("_r"), F.col("_sd20")),
        "Signed_Volume_Flow": lv.total(1, "_flow", 21),
        "Amihud_Illiquidity": F.log1p(lv.mean(1, "_impact", 21) * 1e9),
    }
    last |= {f"Price_to_SMA_{n}": div(p, F.col(f"SMA_{n}")) for n in cfg.sma_windows}
    last |= {f"Vol_{n}d": F.col(f"_sd{n}") * YEAR for n in cfg.vol_windows}
    lv.rows[3] = [last]
    return lv


def with_moving_averages(panel: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """EMA and MACD columns; the signal line is an EMA of the MACD line."""
    fast, slow, signal = cfg.macd
    price = F.col("AdjClose")
    wanted = {f"EMA_{w}": (price, w) for w in cfg.ema_windows}
    wanted |= {"_fast": (price, fast), "_slow": (price, slow)}
    out = with_ema(panel, wanted, {"MACD": F.col("_fast") - F.col("_slow")}, {"MACD_Signal": (F.col("MACD"), signal)})
    return out.drop("_fast", "_slow").withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))


def series_features(panel: DataFrame, cfg: FeatureConfig = FeatureConfig(),
                    only: list[str] | None = None) -> DataFrame:
    """All families (or the named ones) next to Date, Ticker, AdjClose, Close and Volume."""
    table = families(cfg)
    chosen = list(table) if only is None else only
    out = panel
    if {"ema", "macd"} & set(chosen):
        out = with_moving_averages(out, cfg)
    out = _levels(cfg).apply(out.withColumns({"_lp": F.ln("AdjClose"), "_month": F.trunc("Date", "month")}))
    flags = [c for c in ("Z_Score", "Outlier_Z") if c in panel.columns]
    names = [c for f in chosen for c in table[f]]
    return out.select("Date", "Ticker", "AdjClose", "Close", "Volume", *names, *flags)


def causal_flags(panel: DataFrame) -> DataFrame:
    """Trailing flags as features; the whole-sample fence columns are left behind."""
    return panel.select("Date", "Ticker", "Z_Score", F.col("Outlier_Z").cast("double").alias("Outlier_Z"))


def warmup_drop(features: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    return (
        features.withColumn("_pos", F.row_number().over(by_series()) - 1)
        .where(F.col("_pos") >= cfg.warmup).drop("_pos")
    )


def forward_target(features: DataFrame, kind: str = "log_return", horizon: int = 1) -> DataFrame:
    """Label: return over the next `horizon` rows of the same series, and the price it refers to."""
    p = F.col("AdjClose")
    ahead = F.lead(p, horizon).over(by_series())
    if kind == "log_return":
        target = F.ln(ahead) - F.ln(p)
    elif kind == "simple_return":
        target = div(ahead, p) - 1.0
    else:
        raise ValueError(f"unsupported target kind {kind!r}")
    return features.withColumns({"Target": target, "Target_Price": ahead})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name not in NON_FEATURES and f.dataType.simpleString() in
            ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")]


def null_report(features: DataFrame, columns: list[str]) -> DataFrame:
    """(Column, Nulls) for every listed column in one pass."""
    counts = features.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return counts.unpivot([], columns, "Column", "Nulls")


def inf_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema.fields
                           if f.dataType.simpleString() in ("double", "float")})


def drop_missing(features: DataFrame, required: list[str]) -> DataFrame:
    return features.dropna(subset=[*required, "Target"])


def sequence_windows(features: DataFrame, columns: list[str], length: int, horizon: int = 1,
                     by: tuple[str, ...] = ("Ticker",)) -> DataFrame:
    """Arrays of the last `length` rows within (split, series) and the target `horizon` rows later.

    A series of n rows gives n - length - horizon + 1 windows; a window never crosses a `by` group.
    """
    order = Window.partitionBy(*by).orderBy("Date")
    frame = order.rowsBetween(-(length - 1), 0)
    got = features.select(
        *by, "Date",
        F.collect_list(F.array(*[F.col(c) for c in columns])).over(frame).alias("Window"),
        F.lead("Target", horizon).over(order).alias("NextTarget"),
        F.row_number().over(order).alias("_n"),
        F.lead(F.lit(1), horizon).over(order).alias("_has"),
    )
    return got.where((F.col("_n") >= length) & F.col("_has").isNotNull()).drop("_n", "_has")


def feature_table(panel: DataFrame, context: DataFrame, cross: DataFrame, sentiment: DataFrame | None,
                  cfg: EngineConfig) -> DataFrame:
    """Universe rows: families, per-date context (broadcast: one row per session of fixed width), cross-sectional columns
    (one row per session, as wide as the universe, so the planner chooses the join), label, sentiment, warm-up."""
    mine = panel.where(F.col("Ticker").isin(list(cfg.universe)))
    out = series_features(mine, cfg.features)
    out = out.join(F.broadcast(context), "Date", "left").join(cross, "Date", "left")
    out = forward_target(out, cfg.target_kind, cfg.horizon)
    if sentiment is not None:
        out = out.join(sentiment, ["Date", "Ticker"], "left")
    out = warmup_drop(out, cfg.features)
    return inf_to_null(out.where(F.col("Target").isNotNull() & F.col("Target_Price").isNotNull()))


