"""Registered queries: per-series features, context, labels and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions.expr import ERF_A, ERF_P, corr, div, normal_cdf
from loomspan.operators import cleaning, context, features, labels, signals, sketches, stats
from loomspan.operators.portfolio import drawdown_curve
from loomspan.operators.ranking import normalise, quantiles, rank_pct
from loomspan.plans.cleaning_plans import ASOF_SQL, CALENDAR, KEYS, SPLIT_SQL, macro_grid
from loomspan.plans.registry import (BAR_SENTIMENT, BARS, CALM, REGISTRY, FLAGGED, IMPUTED, RAW, SERIES, SPARSE, WIDE_BARS, aligned, g, gcols,
                                     lag, over0, publish, query, roll)
from loomspan.session import materialise, run_dir
from loomspan.sources import fixtures as fx

CFG = fx.BARS_CONFIG
FAMILIES = features.families()
LP = "ln(AdjClose)"
YEAR = "sqrt(252)"
BASE = f"""WITH {BARS}, a AS (SELECT *, {LP} - {lag(LP)} AS r, AdjClose - {lag('AdjClose')} AS dp, Close - {lag('Close')} AS dc,
 {over0('Close', lag('Close'))} - 1 AS ret, ln(High / Low) AS hl FROM fx_bars)"""


def clamp(x: str, lo: str | None, hi: str | None) -> str:
    y = x if hi is None else f"least({x}, {hi})"
    y = y if lo is None else f"greatest({y}, {lo})"
    return f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"


def _simple(exprs: dict[str, str], digits: int = 6, source: str = "a", ctes: str = "") -> str:
    return f"{BASE}{ctes} SELECT Date, Ticker, " + ", ".join(f"{g(e, digits)} AS {n}" for n, e in exprs.items()) + f" FROM {source}"


def _ema_cte(name: str, src: str, x: str, spans: dict[str, int]) -> str:
    """EMA as a weighted sum over all earlier rows of the series."""
    cols = ", ".join(
        f"sum(b.x * (CASE WHEN b.i = 1 THEN 1e0 ELSE 2e0 / {s + 1} END) * pow(1 - 2e0 / {s + 1}, a.i - b.i)) AS {n}" for n, s in spans.items())
    return f"""{name}_n AS (SELECT Date, Ticker, {x} AS x, row_number() OVER ({SERIES}) AS i FROM {src}),
 {name} AS (SELECT a.Date, a.Ticker, {cols} FROM {name}_n a JOIN {name}_n b ON a.Ticker = b.Ticker AND b.i <= a.i GROUP BY a.Date, a.Ticker)"""


TR = f"greatest(abs(High - Low), abs(High - {lag('Close')}), abs(Low - {lag('Close')}))"
GK = "(5e-1 * hl * hl - (2 * ln(2) - 1) * pow(ln(Close / Open), 2))"
RS = "(ln(High / Close) * ln(High / Open) + ln(Low / Close) * ln(Low / Open))"


def _root(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN sqrt(greatest({x}, 0)) END)"


EVER = f"({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
MON = "PARTITION BY Ticker, year(Date), month(Date)"
OBV_CTE = f", o AS (SELECT *, sum(sign(coalesce(dc, 0)) * Volume) OVER {EVER} AS OBV FROM a)"
OBV_Z = over0(f"OBV - {roll('avg', 'OBV', 21)}", roll("stddev_samp", "OBV", 21))

FAMILY_SQL = {
    "log_returns": _simple({f"Return_{w}d": f"{LP} - {lag(LP, w)}" for w in (1, 2, 3, 5, 10, 21)}),
    "reversal": _simple({"Return_Reversal_2d": f"-{roll('sum', 'r', 2)}", "Return_Reversal_5d": f"-({LP} - {lag(LP, 5)})"}),
    "overnight_intraday": _simple({"Overnight_Return": f"ln(Open / {lag('Close')})", "Intraday_Return": "ln(Close / Open)",
                                   "Overnight_Gap_3d": f"ln(Open / {lag('Close', 3)})"}),
    "sma": _simple({n: e for w in (10, 20, 50, 200) for n, e in (
        (f"SMA_{w}", roll("avg", "AdjClose", w)), (f"Price_to_SMA_{w}", over0("AdjClose", roll("avg", "AdjClose", w))))}),
    "ema": f"WITH {BARS}, {_ema_cte('e', 'fx_bars', 'AdjClose', {'EMA_12': 12, 'EMA_26': 26})} SELECT Date, Ticker, {gcols(['EMA_12', 'EMA_26'])} FROM e",
    "macd": f"""WITH {BARS}, {_ema_cte('e', 'fx_bars', 'AdjClose', {'f': 12, 's': 26})}, {_ema_cte('sg', 'e', 'f - s', {'sig': 9})}
 SELECT e.Date, e.Ticker, {g('f - s')} AS MACD, {g('sig')} AS MACD_Signal, {g('f - s - sig')} AS MACD_Hist
 FROM e JOIN sg ON sg.Date = e.Date AND sg.Ticker = e.Ticker""",
    "rsi": _simple({"RSI_14": f"100 - 100 / (1 + {over0(roll('avg', clamp('dp', '0', None), 14), roll('avg', clamp('(-dp)', '0', None), 14))})"}),
    "stochastic": f"""{BASE}, k AS (SELECT Date, Ticker, 100 * {over0(f"Close - {roll('min', 'Low', 14)}", f"{roll('max', 'High', 14)} - {roll('min', 'Low', 14)}")} AS Stoch_K FROM a)
 SELECT Date, Ticker, {g('Stoch_K')} AS Stoch_K, {g(roll('avg', 'Stoch_K', 3))} AS Stoch_D FROM k""",
    "roc": _simple({f"ROC_{w}": f"({over0('AdjClose', lag('AdjClose', w))} - 1) * 100" for w in (5, 20)}),
    "rolling_vol": _simple({f"Vol_{w}d": f"{roll('stddev_samp', 'r', w)} * {YEAR}" for w in (5, 10, 21, 63)}),
    "atr": f"{BASE}, t AS (SELECT *, {TR} AS tr FROM a) SELECT Date, Ticker, {g(over0(roll('avg', 'tr', 14), 'Close'))} AS ATR_14 FROM t",
    "bollinger_width": _simple({"BB_Width": over0(f"4 * {roll('stddev_samp', 'AdjClose', 20)}", roll("avg", "AdjClose", 20))}),
    "range_vols": f"""{BASE}, v AS (SELECT *, hl * hl AS hl2, {GK} AS gk, {RS} AS rs FROM a) SELECT Date, Ticker,
 {g(_root(f"({roll('avg', 'hl2', 21)} / (4 * ln(2)) * 252)"))} AS Vol_Parkinson, {g(_root(f"({roll('avg', 'gk', 21)} * 252)"))} AS Vol_GarmanKlass,
 {g(_root(f"({roll('avg', 'rs', 21)} * 252)"))} AS Vol_RogersSatchell FROM v""",
    "vol_of_vol": f"""{BASE}, s AS (SELECT *, {roll('stddev_samp', 'r', 21)} AS sd FROM a) SELECT Date, Ticker,
 {g(f"{roll('stddev_samp', 'sd', 63)} * {YEAR}")} AS Vol_Of_Vol, {g(over0(roll('stddev_samp', 'r', 10), roll('stddev_samp', 'r', 63)))} AS Vol_Ratio_Short_Long FROM s""",
    "drawdown_state": _simple({
        "Drawdown_From_Peak": f"AdjClose / max(AdjClose) OVER {EVER} - 1",
        "Distance_From_52w_High": f"AdjClose / {roll('max', 'AdjClose', 252)} - 1",
        "Position_In_52w_Range": clamp(over0(f"AdjClose - {roll('min', 'AdjClose', 252)}", f"{roll('max', 'AdjClose', 252)} - {roll('min', 'AdjClose', 252)}"), "-5e-1", "15e-1")}),
    "efficiency_ratio": f"{BASE}, p AS (SELECT *, abs(dp) AS ad, abs(AdjClose - {lag('AdjClose', 21)}) AS n21, abs(AdjClose - {lag('AdjClose', 63)}) AS n63 FROM a) SELECT Date, Ticker, "
    + ", ".join(g(clamp(over0(f"n{w}", roll("sum", "ad", w)), "0", "1")) + f" AS Efficiency_Ratio_{w}" for w in (21, 63)) + " FROM p",
    "volume_z": _simple({
        "Volume_Z": over0(f"Volume - {roll('avg', 'Volume', 21)}", roll("stddev_samp", "Volume", 21)),
        "Volume_Change": f"{over0('Volume', lag('Volume'))} - 1", "Volume_MA_20": roll("avg", "Volume", 20),
        "Volume_MA_Ratio": over0("Volume", roll("avg", "Volume", 20)), "Relative_Volume_21": over0("Volume", roll("avg", "Volume", 21))}),
    "obv": _simple({"OBV": "OBV", "OBV_Z": OBV_Z}, source="o", ctes=OBV_CTE),
    "volume_price_div": _simple({"Volume_Price_Div": f"{OBV_Z} - {over0('r', roll('stddev_samp', 'r', 20))}"}, source="o", ctes=OBV_CTE),
    "signed_volume_flow": f"{BASE}, f AS (SELECT *, sign(ret) * Volume * abs(ret) AS flow FROM a) SELECT Date, Ticker, {g(roll('sum', 'flow', 21))} AS Signed_Volume_Flow FROM f",
    "amihud": f"""{BASE}, i AS (SELECT *, {over0('abs(ret)', 'Close * Volume')} AS imp FROM a) SELECT Date, Ticker,
 {g(f"ln(1 + {roll('avg', 'imp', 21)} * 1e9)")} AS Amihud_Illiquidity, {g('ln(1 + Close * Volume)')} AS Log_Dollar_Volume FROM i""",
    "calendar_feats": f"""WITH {BARS}, p AS (SELECT Date, Ticker, row_number() OVER ({MON} ORDER BY Date) - 1 AS pos, count(*) OVER ({MON}) AS n FROM fx_bars)
 SELECT Date, Ticker, {g('isodow(Date) - 1')} AS DayOfWeek, {g('month(Date)')} AS Month, {g('CASE WHEN pos < 2 OR n - 1 - pos < 2 THEN 1 ELSE 0 END')} AS TurnOfMonth FROM p""",
    "lags": _simple({n: e for k in (1, 2, 3, 5) for n, e in ((f"Close_Lag_{k}", lag("AdjClose", k)), (f"Return_Lag_{k}", lag("r", k)))}),
}


def _register_family(name: str) -> None:
    @query(name, FAMILY_SQL[name])
    def _(spark, sf):
        return publish(features.series_features(fx.bars(spark, sf), only=[name]), KEYS, FAMILIES[name])


for _name in FAMILIES:
    _register_family(_name)


# the first end-to-end slice --------------------------------------------------------------------------

FLAGSHIP = ["Return_1d", "Return_5d", "Return_21d", "SMA_10", "SMA_50", "SMA_200", "Vol_21d", "Vol_63d"]


@query("flagship_features", f"""WITH {RAW}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Date, Ticker ORDER BY
 CASE WHEN AdjClose IS NULL THEN 1 ELSE 0 END, Close DESC) AS rn FROM fx_raw) WHERE rn = 1), {aligned('best', CALENDAR)}, {IMPUTED},
 a AS (SELECT *, {LP} - {lag(LP)} AS r FROM imputed WHERE Close IS NOT NULL AND AdjClose IS NOT NULL),
 f AS (SELECT Date, Ticker, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS rn, r AS Return_1d, {LP} - {lag(LP, 5)} AS Return_5d,
  {LP} - {lag(LP, 21)} AS Return_21d, {roll('avg', 'AdjClose', 10)} AS SMA_10, {roll('avg', 'AdjClose', 50)} AS SMA_50, {roll('avg', 'AdjClose', 200)} AS SMA_200,
  {roll('stddev_samp', 'r', 21)} * {YEAR} AS Vol_21d, {roll('stddev_samp', 'r', 63)} * {YEAR} AS Vol_63d FROM a)
 SELECT Date, Ticker, {gcols(FLAGSHIP)} FROM f WHERE rn = 1""")
def flagship(spark, sf):
    raw = fx.raw_with_repeats(spark, sf)
    panel = cleaning.drop_unusable(cleaning.impute_gaps(cleaning.align_calendar(cleaning.dedup_best_record(raw), CALENDAR)))
    feats = features.series_features(panel, only=["log_returns", "sma", "rolling_vol"])
    return publish(signals.latest_per_key(feats), KEYS, FLAGSHIP)


@query("series_features_many", f"""WITH {WIDE_BARS}, a AS (SELECT *, {LP} - {lag(LP)} AS r, AdjClose - {lag('AdjClose')} AS dp FROM fx_wide)
 SELECT Date, Ticker, {g(f'{LP} - {lag(LP, 5)}')} AS Return_5d, {g(roll('avg', 'AdjClose', 50))} AS SMA_50, {g(f"{roll('stddev_samp', 'r', 63)} * {YEAR}")} AS Vol_63d,
 {g(f"AdjClose / {roll('max', 'AdjClose', 252)} - 1")} AS Distance_From_52w_High FROM a""")
def _(spark, sf):
    return publish(features.series_features(fx.wide_bars(spark, sf)), KEYS, ["Return_5d", "SMA_50", "Vol_63d", "Distance_From_52w_High"])


@query("causal_flags", f"WITH {SPARSE}, {aligned('fx_sparse', CALENDAR)}, {IMPUTED}, {FLAGGED} SELECT Date, Ticker, {g('Z_Score')} AS Z_Score, {g('CAST(Outlier_Z AS INT)')} AS Outlier_Z FROM flagged")
def _(spark, sf):
    flagged = cleaning.flag_outliers(cleaning.impute_gaps(cleaning.align_calendar(fx.sparse_bars(spark, sf), CALENDAR)))
    return publish(features.causal_flags(flagged), KEYS, ["Z_Score", "Outlier_Z"])


@query("forward_target", f"""WITH {BARS} SELECT Date, Ticker, {g(f'lead({LP}) OVER ({SERIES}) - {LP}')} AS Target, {g(f'lead(AdjClose) OVER ({SERIES})')} AS Target_Price FROM fx_bars""")
def _(spark, sf):
    return publish(features.forward_target(fx.bars(spark, sf)), KEYS, ["Target", "Target_Price"])


@query("warmup_drop", f"WITH {BARS}, p AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM fx_bars) SELECT Date, Ticker, {g('Close')} AS Close FROM p WHERE rn >= 200")
def _(spark, sf):
    return publish(features.warmup_drop(fx.bars(spark, sf)), KEYS, ["Close"])


@query("sequence_windows", SPLIT_SQL + f""", q AS (SELECT b.Date, Ticker, Split, AdjClose, Volume FROM fx_bars b JOIN sp ON sp.Date = b.Date),
 s AS (SELECT Date, Ticker, Split, list([AdjClose, Volume]) OVER (PARTITION BY Split, Ticker ORDER BY Date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS w,
  lead(AdjClose) OVER (PARTITION BY Split, Ticker ORDER BY Date) AS nxt FROM q)
 SELECT Split, Ticker, Date, CAST(len(w) AS INTEGER) AS length, {g('w[1][1]')} AS first_value, {g('w[60][2]')} AS last_volume,
 {g('list_sum(list_transform(w, lambda x: x[1]))', 4)} AS window_sum, {g('nxt')} AS NextTarget FROM s WHERE len(w) = 60 AND nxt IS NOT NULL""")
def _(spark, sf):
    rows = labels.with_split(fx.bars(spark, sf)).withColumn("Target", F.col("AdjClose"))
    w = features.sequence_windows(rows, ["AdjClose", "Volume"], 60, by=("Split", "Ticker"))
    out = w.select(
        "Split", "Ticker", "Date", F.size("Window").alias("length"), F.col("Window")[0][0].alias("first_value"),
        F.col("Window")[59][1].alias("last_volume"),
        F.aggregate("Window", F.lit(0.0), lambda s, x: s + x[0]).alias("window_sum"), "NextTarget")
    return publish(out, ["Split", "Ticker", "Date", "length"], ["first_value", "last_volume", "window_sum", "NextTarget"], {"window_sum": 4})


# context -------------------------------------------------------------------------------------------------

MARKET = ["Market_Return_1d", "Market_Return_5d", "Market_Return_21d", "Market_Vol_21d", "Market_Cumulative", "VIX_Level", "VIX_Change_1d", "VIX_MA_21"]
MACRO_COLS = ["Yield_Spread_10Y_3M", "Yield_Spread_Change_21d", "CPI_Mom_12m", "CPI_Mom_1m"]


def lagd(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (ORDER BY Date)"


MARKET_SQL = ASOF_SQL + f""", i0 AS (SELECT Date, Ticker, AdjClose, {LP} - {lagd(LP)} AS r FROM fx_bars WHERE Ticker = 'NO'),
 i AS (SELECT Date, r AS Market_Return_1d, {LP} - {lagd(LP, 5)} AS Market_Return_5d, {LP} - {lagd(LP, 21)} AS Market_Return_21d,
  {roll('stddev_samp', 'r', 21)} * {YEAR} AS Market_Vol_21d, AdjClose / first_value(AdjClose) OVER (ORDER BY Date) AS Market_Cumulative FROM i0),
 v AS (SELECT Date, Close AS VIX_Level, Close - {lagd('Close')} AS VIX_Change_1d, {roll('avg', 'Close', 21)} AS VIX_MA_21 FROM fx_bars WHERE Ticker = 'RO'),
 mw AS (SELECT Date, max(CASE WHEN Series = 'F' THEN Value END) AS a, max(CASE WHEN Series = 'O' THEN Value END) AS b, max(CASE WHEN Series = 'P' THEN Value END) AS c FROM known GROUP BY Date),
 mm AS (SELECT i.*, v.VIX_Level, v.VIX_Change_1d, v.VIX_MA_21, a - b AS sp, c FROM i LEFT JOIN v ON v.Date = i.Date LEFT JOIN mw ON mw.Date = i.Date),
 ctx AS (SELECT *, sp AS Yield_Spread_10Y_3M, sp - {lagd('sp', 21)} AS Yield_Spread_Change_21d,
  (c / {lagd('c', 252)} - 1) * 100 AS CPI_Mom_12m, (c / {lagd('c', 21)} - 1) * 100 AS CPI_Mom_1m FROM mm)"""


def market(spark, sf, bars=None):
    names = F.create_map(*[F.lit(x) for x in ("F", "DGS10", "O", "DGS3MO", "P", "CPIAUCSL")])
    grid = macro_grid(spark, sf).withColumn("Series", names[F.col("Series")])
    return context.market_context(fx.bars(spark, sf) if bars is None else bars, CFG, grid)


@query("market_context", MARKET_SQL + f" SELECT Date, {gcols(MARKET + MACRO_COLS)} FROM ctx")
def _(spark, sf):
    return publish(market(spark, sf), ["Date"], MARKET + MACRO_COLS)


@query("context_join", MARKET_SQL + f" SELECT b.Date, b.Ticker, {g('Close')} AS Close, {gcols(['Market_Return_1d', 'VIX_Level'])} FROM fx_bars b LEFT JOIN ctx ON ctx.Date = b.Date")
def _(spark, sf):
    return publish(context.context_join(fx.bars(spark, sf).select(*KEYS, "Close"), market(spark, sf)), KEYS,
                   ["Close", "Market_Return_1d", "VIX_Level"])


XS = f"""WITH {BARS}, dd AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS si FROM (SELECT DISTINCT Date FROM fx_bars)),
 x0 AS (SELECT b.Date, b.Ticker, si, {LP} AS lp FROM fx_bars b JOIN dd ON dd.Date = b.Date),
 x1 AS (SELECT Date, Ticker, si, CASE WHEN si - lag(si) OVER (PARTITION BY Ticker ORDER BY si) = 1 THEN lp - lag(lp) OVER (PARTITION BY Ticker ORDER BY si) END AS r FROM x0),
 u AS (SELECT * FROM x1 WHERE Ticker IN ('AF','AO','NF','RF')),
 br AS (SELECT dd.Date, avg(r) AS Cross_Section_Return, count(CASE WHEN r > 0 THEN 1 END) / 4e0 AS Universe_Breadth, stddev_samp(r) AS Universe_Dispersion
  FROM dd LEFT JOIN u ON u.Date = dd.Date GROUP BY dd.Date),
 mk AS (SELECT Date, r AS m, CASE WHEN count(r) OVER w >= 60 THEN var_samp(r) OVER w END AS mv FROM x1 WHERE Ticker = 'NO'
  WINDOW w AS (ORDER BY si RANGE BETWEEN 251 PRECEDING AND CURRENT ROW)),
 bt AS (SELECT u.Date, si, Ticker, r, m, CASE WHEN count(r + m) OVER w >= 60 THEN covar_samp(r, m) OVER w END / nullif(mv, 0) AS Beta
  FROM u LEFT JOIN mk ON mk.Date = u.Date WINDOW w AS (PARTITION BY Ticker ORDER BY si RANGE BETWEEN 251 PRECEDING AND CURRENT ROW)),
 id0 AS (SELECT *, r - m * Beta AS Idiosyncratic FROM bt),
 idi AS (SELECT id0.Date, Ticker, Beta, Idiosyncratic, CASE WHEN count(Idiosyncratic) OVER w = 5 THEN sum(Idiosyncratic) OVER w END AS Idiosyncratic_5d,
  r - Cross_Section_Return AS Relative_Strength FROM id0 JOIN br ON br.Date = id0.Date
  WINDOW w AS (PARTITION BY Ticker ORDER BY si RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))"""
BREADTH = ["Cross_Section_Return", "Universe_Breadth", "Universe_Dispersion"]
IDIO = ["Beta", "Idiosyncratic", "Idiosyncratic_5d", "Relative_Strength"]
MOMENTS = ["Idiosyncratic_Mean", "Idiosyncratic_Dispersion", "Relative_Strength_Mean", "Relative_Strength_Spread", "Beta_Cross_Section_Mean"]


@query("breadth_dispersion", XS + f" SELECT Date, {gcols(BREADTH)} FROM br")
def _(spark, sf):
    return publish(context.breadth_dispersion(fx.bars(spark, sf), CFG), ["Date"], BREADTH)


@query("rsum_peer", XS + f""" SELECT Date, {g('CASE WHEN count(Cross_Section_Return) OVER w = 5 THEN sum(Cross_Section_Return) OVER w END')} AS Peer_Mean_Return_5d,
 {g('CASE WHEN count(Universe_Dispersion) OVER w = 5 THEN avg(Universe_Dispersion) OVER w END')} AS Universe_Dispersion_5d FROM br
 WINDOW w AS (ORDER BY Date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return publish(context.rolling_peer(context.breadth_dispersion(fx.bars(spark, sf), CFG)), ["Date"],
                   ["Peer_Mean_Return_5d", "Universe_Dispersion_5d"])


@query("rolling_beta", XS + f" SELECT Date, Ticker, {g('Beta')} AS Beta FROM bt")
def _(spark, sf):
    return publish(context.rolling_beta(fx.bars(spark, sf), CFG), KEYS, ["Beta"])


@query("idiosyncratic", XS + f" SELECT Date, Ticker, {gcols(IDIO)} FROM idi")
def _(spark, sf):
    return publish(context.idiosyncratic(fx.bars(spark, sf), CFG), KEYS, IDIO)


@query("xs_moments", XS + f""" SELECT Date, {g('avg(Idiosyncratic)')} AS Idiosyncratic_Mean, {g('stddev_samp(Idiosyncratic)')} AS Idiosyncratic_Dispersion,
 {g('avg(Relative_Strength)')} AS Relative_Strength_Mean, {g('max(Relative_Strength) - min(Relative_Strength)')} AS Relative_Strength_Spread,
 {g('avg(Beta)')} AS Beta_Cross_Section_Mean FROM idi GROUP BY Date""")
def _(spark, sf):
    return publish(context.cross_moments(context.idiosyncratic(fx.bars(spark, sf), CFG)), ["Date"], MOMENTS)


@query("cross_sectional_context", XS + f""", pv AS (SELECT Date, avg(Idiosyncratic) AS im, max(CASE WHEN Ticker = 'AF' THEN Beta END) AS baf,
 max(CASE WHEN Ticker = 'RF' THEN Idiosyncratic_5d END) AS irf FROM idi GROUP BY Date)
 SELECT br.Date, {gcols(BREADTH)}, {g('im')} AS Idiosyncratic_Mean, {g('baf')} AS Beta_AF, {g('irf')} AS Idiosyncratic_RF_5d FROM br LEFT JOIN pv ON pv.Date = br.Date""")
def _(spark, sf):
    return publish(context.cross_sectional_context(fx.bars(spark, sf), CFG), ["Date"],
                   [*BREADTH, "Idiosyncratic_Mean", "Beta_AF", "Idiosyncratic_RF_5d"])


NAME_COLS = {"Beta": "Beta_{t}", "Idiosyncratic": "Idiosyncratic_{t}", "Idiosyncratic_5d": "Idiosyncratic_{t}_5d", "Relative_Strength": "Relative_Strength_{t}"}
CROSS_COLS = [*BREADTH, "Peer_Mean_Return_5d", "Universe_Dispersion_5d", *MOMENTS, *[n.format(t=t) for n in NAME_COLS.values() for t in CFG.universe]]
TABLE_COLS = [*[c for f in FAMILIES.values() for c in f], *MARKET, *MACRO_COLS, *CROSS_COLS, "Sentiment_FinBERT", "Target", "Target_Price"]
NAME_SQL = ", ".join(f"max(CASE WHEN Ticker = '{t}' THEN {c} END) AS {n.format(t=t)}" for c, n in NAME_COLS.items() for t in CFG.universe)


def model_table(spark, sf):
    """The panel, six series over the calendar, is written once: every part reads that instead of the lines it is made of."""
    p = materialise(fx.bars(spark, sf), "model-bars")
    return features.feature_table(p, market(spark, sf, p), context.cross_sectional_context(p, CFG), fx.bar_sentiment_of(p), CFG)


@query("feature_table", f"""WITH {BARS}, {BAR_SENTIMENT}, a0 AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM fx_bars WHERE Ticker IN ('AF','AO','NF','RF')),
 ft AS (SELECT Date, Ticker, rn, {g(f'lead({LP}) OVER ({SERIES}) - {LP}')} AS Target, {g(f'lead(AdjClose) OVER ({SERIES})')} AS Target_Price FROM a0)
 SELECT ft.Date, ft.Ticker, {', '.join(c for c in TABLE_COLS if c != 'Sentiment_FinBERT')}, {g('Sentiment_FinBERT')} AS Sentiment_FinBERT FROM ft """
       + " ".join(f"JOIN ({FAMILY_SQL[f]}) f{i} ON f{i}.Date = ft.Date AND f{i}.Ticker = ft.Ticker" for i, f in enumerate(FAMILIES))
       + " ".join(f" LEFT JOIN ({REGISTRY[q].sql}) {q} ON {q}.Date = ft.Date" for q in ("market_context", "breadth_dispersion", "rsum_peer", "xs_moments"))
       + f""" LEFT JOIN (SELECT Date, {NAME_SQL} FROM ({REGISTRY['idiosyncratic'].sql}) i GROUP BY Date) pn ON pn.Date = ft.Date
 LEFT JOIN fx_sent s ON s.Date = ft.Date AND s.Ticker = ft.Ticker WHERE rn >= 200 AND Target IS NOT NULL AND Target_Price IS NOT NULL""")
def _(spark, sf):
    """The assembled model table with every column: families, market and cross-sectional context, sentiment, label, warm-up removed."""
    return publish(model_table(spark, sf), KEYS, TABLE_COLS)


# ranks, labels and folds ------------------------------------------------------------------------------------

def rank_sql(value: str, by: str, src: str) -> str:
    return f"""(SELECT *, CASE WHEN {value} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {value} NULLS LAST)
 + (count({value}) OVER (PARTITION BY {by}, {value}) - 1) / 2e0) / count({value}) OVER (PARTITION BY {by}) END AS pct FROM {src})"""


@query("rank_pct", f"WITH {WIDE_BARS} SELECT Date, Ticker, {g('pct')} AS pct FROM {rank_sql('Volume', 'Date', 'fx_wide')}")
def _(spark, sf):
    """Ranks of all series per date; the number of series grows with the data, so no bound is given."""
    return publish(rank_pct(fx.wide_bars(spark, sf), ["Date"], "Volume", "pct"), KEYS, ["pct"])


@query("rank_pct_universe", f"WITH {BARS} SELECT Date, Ticker, {g('pct')} AS pct FROM {rank_sql('Volume', 'Date', 'fx_bars')}")
def _(spark, sf):
    return publish(rank_pct(fx.bars(spark, sf), ["Date"], "Volume", "pct", group_bound=6), KEYS, ["pct"])


@query("normalise_rank", f"""WITH {WIDE_BARS}, k AS {rank_sql('Volume', 'Date', 'fx_wide')},
 n AS (SELECT *, min(Volume) OVER (PARTITION BY Date) = max(Volume) OVER (PARTITION BY Date) AS flat FROM k)
 SELECT Date, Ticker, {g('CASE WHEN flat THEN 5e-1 ELSE pct END')} AS unit FROM n""")
def _(spark, sf):
    return publish(normalise(fx.wide_bars(spark, sf), ["Date"], "Volume", "unit"), KEYS, ["unit"])


@query("daily_demean", f"""WITH {BARS}, t AS (SELECT * FROM (SELECT Date, Ticker, lead({LP}) OVER ({SERIES}) - {LP} AS Target FROM fx_bars) WHERE Target IS NOT NULL),
 d AS (SELECT *, Target - avg(Target) OVER (PARTITION BY Date) AS Relative_Target FROM t)
 SELECT Date, Ticker, {g('Relative_Target')} AS Relative_Target, {g('pct - 5e-1')} AS Rank_Target FROM {rank_sql('Target', 'Date', 'd')}""")
def _(spark, sf):
    rows = features.forward_target(fx.bars(spark, sf)).where(F.col("Target").isNotNull())
    return publish(labels.daily_demean(rows, group_bound=6), KEYS, ["Relative_Target", "Rank_Target"])


FOLD_SQL = f"""WITH {BARS}, t AS (SELECT Date, Ticker, Target, row_number() OVER (ORDER BY Date, Ticker) - 1 AS pos, count(*) OVER () AS n FROM
  (SELECT Date, Ticker, lead({LP}) OVER ({SERIES}) - {LP} AS Target FROM fx_bars) WHERE Target IS NOT NULL),
 k AS (SELECT *, greatest(2, least(5, greatest(2, n // 400))) AS k FROM t),
 q AS (SELECT *, greatest(500, n // (k + 2)) AS test FROM k),
 fo AS (SELECT q.*, f AS Fold, n - (k - f) * test AS start FROM q, range(5) r(f) WHERE f < k),
 ro AS (SELECT *, CASE WHEN pos < start THEN 'train' WHEN pos < start + test THEN 'validate' END AS Role FROM fo)"""


def folds(spark, sf):
    rows = features.forward_target(fx.bars(spark, sf)).where(F.col("Target").isNotNull())
    return labels.walk_forward_folds(rows, group_bound=6)


@query("walk_forward_folds", FOLD_SQL + f""" SELECT CAST(Fold AS INTEGER) AS Fold, Role, count(*) AS n_rows, min(Date) AS first_date, max(Date) AS last_date,
 {g('sum(Target)')} AS target_sum FROM ro WHERE Role IS NOT NULL GROUP BY Fold, Role""")
def _(spark, sf):
    out = folds(spark, sf).groupBy("Fold", "Role").agg(
        F.count("*").alias("n_rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"), F.sum("Target").alias("target_sum"))
    return publish(out, ["Fold", "Role", "n_rows", "first_date", "last_date"], ["target_sum"])


@query("global_position", f"WITH {WIDE_BARS} SELECT Date, Ticker, row_number() OVER (ORDER BY Date, Ticker) - 1 AS Pos, count(*) OVER () AS Total FROM fx_wide")
def _(spark, sf):
    """Row positions over all supplier series; a date may hold any number of rows."""
    return labels.global_position(fx.wide_bars(spark, sf).select(*KEYS)).select(*KEYS, F.col("Pos").cast("long").alias("Pos"), "Total")


@query("vol_vix_correlation", MARKET_SQL + f" SELECT {g('corr(Market_Vol_21d, VIX_Level)')} AS corr, count(Market_Vol_21d + VIX_Level) AS sessions FROM ctx")
def _(spark, sf):
    """Realised index volatility against the volatility index, aligned on the date."""
    m = context.market_context(fx.bars(spark, sf), CFG)
    out = m.agg(corr(F.col("Market_Vol_21d"), F.col("VIX_Level")).alias("corr"), F.count(F.col("Market_Vol_21d") + F.col("VIX_Level")).alias("sessions"))
    return publish(out, ["sessions"], ["corr"])


@query("standard_scale", SPLIT_SQL + f""", q AS (SELECT b.Date, Ticker, Split, AdjClose, Volume FROM fx_bars b JOIN sp ON sp.Date = b.Date),
 s AS (SELECT avg(AdjClose) AS ma, stddev_pop(AdjClose) AS sa, avg(Volume) AS mv, stddev_pop(Volume) AS sv FROM q WHERE Split = 'train')
 SELECT Date, Ticker, {g('(AdjClose - ma) / sa')} AS AdjClose, {g('(Volume - mv) / sv')} AS Volume FROM q, s""")
def _(spark, sf):
    from loomspan.operators.models import standard_scale
    rows = labels.with_split(fx.bars(spark, sf))
    return publish(standard_scale(rows, ["AdjClose", "Volume"], F.col("Split") == "train"), KEYS, ["AdjClose", "Volume"])


# statistics -----------------------------------------------------------------------------------------------

RETURNS = f"WITH {BARS}, rr AS (SELECT * FROM (SELECT Date, Ticker, {LP} - {lag(LP)} AS r FROM fx_bars) WHERE r IS NOT NULL)"
WIDE_RETURNS = f"WITH {WIDE_BARS}, rr AS (SELECT * FROM (SELECT Date, Ticker, {LP} - {lag(LP)} AS r FROM fx_wide) WHERE r IS NOT NULL)"


def returns(spark, sf):
    return stats.log_returns(fx.bars(spark, sf))


@query("moments", RETURNS + f""" SELECT Ticker, count(*) AS n, {g('avg(r)')} AS mean, {g('var_pop(r)')} AS variance,
 {g(f'stddev_pop(r) * {YEAR}')} AS annual_vol, {g('avg(r) * 252')} AS annual_mean FROM rr GROUP BY Ticker""")
def _(spark, sf):
    return publish(stats.moments(returns(spark, sf)), ["Ticker", "n"], ["mean", "variance", "annual_vol", "annual_mean"])


@query("skew_kurt_jb", RETURNS + f""", c AS (SELECT Ticker, r - avg(r) OVER (PARTITION BY Ticker) AS d FROM rr),
 m AS (SELECT Ticker, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY Ticker),
 k AS (SELECT Ticker, n, m3 / pow(m2, 15e-1) AS skew, m4 / (m2 * m2) - 3 AS excess_kurtosis FROM m),
 j AS (SELECT *, n / 6e0 * (skew * skew + excess_kurtosis * excess_kurtosis / 4) AS jb FROM k)
 SELECT Ticker, n, {gcols(['skew', 'excess_kurtosis', 'jb'])}, {g('exp(-jb / 2)')} AS p_value FROM j""")
def _(spark, sf):
    return publish(stats.skew_kurt_jb(returns(spark, sf)), ["Ticker", "n"], ["skew", "excess_kurtosis", "jb", "p_value"])


@query("histogram", RETURNS + f""", b AS (SELECT min(r) AS lo, max(r) AS hi, avg(r) AS mean, stddev_samp(r) AS sd FROM rr),
 c AS (SELECT CAST(least(119, floor((r - lo) / ((hi - lo) / 120))) AS INTEGER) AS bin, count(*) AS n FROM rr, b GROUP BY 1)
 SELECT bin, n AS "count", {g('lo + (bin + 5e-1) * ((hi - lo) / 120)')} AS mid,
 {g('exp(-5e-1 * pow((lo + (bin + 5e-1) * ((hi - lo) / 120) - mean) / sd, 2)) / (sd * 2.5066282746310002e0)')} AS normal_density FROM c, b""")
def _(spark, sf):
    return publish(stats.histogram(returns(spark, sf), 120), ["bin", "count"], ["mid", "normal_density"])


@query("var_empirical", WIDE_RETURNS + f" SELECT {g('quantile_cont(r, 5e-2)')} AS var, {g('quantile_cont(r, 5e-1)')} AS median FROM rr")
def _(spark, sf):
    """All returns of all series form one group; it is unbounded, so the ranged plan is used."""
    return publish(quantiles(stats.log_returns(fx.wide_bars(spark, sf)), [], "r", {"var": 0.05, "median": 0.5}), [], ["var", "median"])


@query("quantiles_by_series", WIDE_RETURNS + f" SELECT Ticker, {g('quantile_cont(r, 25e-3)')} AS lo, {g('quantile_cont(r, 975e-3)')} AS hi FROM rr GROUP BY Ticker")
def _(spark, sf):
    return publish(quantiles(stats.log_returns(fx.wide_bars(spark, sf)), ["Ticker"], "r", {"lo": 0.025, "hi": 0.975}, group_bound=40_000),
                   ["Ticker"], ["lo", "hi"])


@query("cvar", WIDE_RETURNS + f", q AS (SELECT quantile_cont(r, 5e-2) AS v FROM rr) SELECT {g('max(v)')} AS var, {g('avg(CASE WHEN r <= v THEN r END)')} AS cvar FROM rr, q")
def _(spark, sf):
    return publish(stats.var_cvar(stats.log_returns(fx.wide_bars(spark, sf)), []), [], ["var", "cvar"])


def month_sketches(spark, sf):
    """Written month by month, then the last month once more, as after a corrected day."""
    rows = materialise(sketches.by_month(stats.log_returns(fx.wide_bars(spark, sf))), "month-rows")
    path = run_dir(spark, "month-sketches")
    sketches.write(rows, path)
    last = rows.agg(F.max("Month")).head()[0]
    if last is not None:
        sketches.write(rows.where(F.col("Month") == F.lit(last)), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("moments_merged", WIDE_RETURNS + f" SELECT Ticker, count(*) AS n, {g('avg(r)')} AS mean, {g('var_pop(r)')} AS variance, {g('min(r)')} AS low, {g('max(r)')} AS high FROM rr GROUP BY Ticker")
def _(spark, sf):
    return publish(sketches.merged(month_sketches(spark, sf)), ["Ticker", "n"], ["mean", "variance", "low", "high"])


@query("var_sketch")
def _(spark, sf):
    """Value at risk and tail mean of every series from merged sketches; their rank error is tested, not their digits."""
    out = sketches.merged(month_sketches(spark, sf))
    return publish(out.select("Ticker", "n", sketches.quantile(0.05).alias("var"), sketches.tail_mean(0.05).alias("cvar")), ["Ticker", "n"], ["var", "cvar"])


ASSETS = list(CFG.universe)
WIDE_SQL = f"""WITH {CALM}, pw AS (SELECT Date, max(CASE WHEN Ticker = 'AF' THEN AdjClose END) AS AF, max(CASE WHEN Ticker = 'AO' THEN AdjClose END) AS AO,
 max(CASE WHEN Ticker = 'NF' THEN AdjClose END) AS NF, max(CASE WHEN Ticker = 'RF' THEN AdjClose END) AS RF, max(CASE WHEN Ticker = 'NO' THEN AdjClose END) AS NOB FROM fx_calm GROUP BY Date),
 pf AS (SELECT * FROM pw WHERE AF IS NOT NULL AND AO IS NOT NULL AND NF IS NOT NULL AND RF IS NOT NULL AND NOB IS NOT NULL),
 wr AS (SELECT * FROM (SELECT Date, {', '.join(f'ln({t}) - lag(ln({t})) OVER (ORDER BY Date) AS {t}' for t in ('AF', 'AO', 'NF', 'RF', 'NOB'))} FROM pf) WHERE AF IS NOT NULL)"""
PAIRS = [(a, b) for i, a in enumerate(ASSETS) for b in ASSETS[i + 1:]]


def wide(spark, sf):
    """Returns of the universe and the benchmark over their common dates."""
    return stats.wide_returns(fx.calm_bars(spark, sf), (*ASSETS, CFG.benchmark))


@query("corr_matrix", WIDE_SQL + " " + " UNION ALL ".join(f"SELECT '{a}' AS asset_i, '{b}' AS asset_j, {g(f'corr({a}, {b})')} AS corr FROM wr" for a, b in PAIRS))
def _(spark, sf):
    return publish(stats.corr_matrix(wide(spark, sf), ASSETS), ["asset_i", "asset_j"], ["corr"])


@query("max_offdiag", WIDE_SQL + " SELECT " + g("greatest(" + ", ".join(f"abs(corr({a}, {b}))" for a, b in PAIRS) + ")") + " AS max_abs_corr FROM wr")
def _(spark, sf):
    return publish(stats.max_offdiag(stats.corr_matrix(wide(spark, sf), ASSETS)), [], ["max_abs_corr"])


@query("spearman_matrix", WIDE_SQL + ", rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2e0 AS {a}" for a in ASSETS) + " FROM wr) "
    + " UNION ALL ".join(f"SELECT '{a}' AS asset_i, '{b}' AS asset_j, {g(f'corr({a}, {b})')} AS corr FROM rk" for a, b in PAIRS))
def _(spark, sf):
    return publish(stats.corr_matrix(stats.ranked_columns(wide(spark, sf), ASSETS), ASSETS), ["asset_i", "asset_j"], ["corr"])


@query("cov_matrix", WIDE_SQL + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS asset_i, '{b}' AS asset_j, {g(f'covar_samp({a}, {b})', 9)} AS cov FROM wr" for a, b in [*PAIRS, *[(a, a) for a in ASSETS]]))
def _(spark, sf):
    return publish(stats.cov_matrix(wide(spark, sf), ASSETS), ["asset_i", "asset_j"], ["cov"], 9)


@query("pair_self_join", WIDE_SQL + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS asset_i, '{b}' AS asset_j, {g(f'corr({a}, {b})')} AS corr, {g(f'covar_samp({a}, {b})', 6)} AS cov, {g(f'regr_slope({b}, {a})')} AS slope, count(*) AS n FROM wr" for a, b in PAIRS))
def _(spark, sf):
    got = stats.pair_stats(wide(spark, sf), ASSETS, {"corr": corr, "cov": F.covar_samp, "slope": lambda a, b: F.regr_slope(b, a), "n": lambda a, b: F.count(a)})
    return publish(got, ["asset_i", "asset_j", "n"], ["corr", "cov", "slope"])


@query("beta_ols", RETURNS + f""", b AS (SELECT Date, r AS m FROM rr WHERE Ticker = 'NO')
 SELECT Ticker, count(*) AS n, {g('covar_pop(r, m)')} AS covariance, {g('corr(r, m)')} AS correlation, {g('covar_pop(r, m) / var_pop(m)')} AS beta
 FROM rr JOIN b ON b.Date = rr.Date WHERE Ticker <> 'NO' GROUP BY Ticker""")
def _(spark, sf):
    return publish(stats.beta_ols(returns(spark, sf), CFG.benchmark), ["Ticker", "n"], ["covariance", "correlation", "beta"])


def _quantile_sql(p: str) -> str:
    from loomspan.functions.expr import INV_A, INV_B, INV_C, INV_D
    a, b, c, d = ([f"CAST('{v!r}' AS DOUBLE)" for v in t] for t in (INV_A, INV_B, INV_C, INV_D))

    def poly(cs, x):
        acc = cs[0]
        for k in cs[1:]:
            acc = f"({acc} * {x} + {k})"
        return acc

    q = f"({p} - 5e-1)"
    r = f"({q} * {q})"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"(CASE WHEN {p} < 2425e-5 THEN {poly(c, lo)} / ({poly(d, lo)} * {lo} + 1) WHEN {p} > 1 - 2425e-5 THEN -{poly(c, hi)} / ({poly(d, hi)} * {hi} + 1) "
            f"ELSE {poly(a, r)} * {q} / ({poly(b, r)} * {r} + 1) END)")


def _cdf_sql(z: str) -> str:
    t = f"(1e0 / (1e0 + {ERF_P}e0 * abs({z}) / 1.4142135623730951e0))"
    poly = "0e0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}e0) * {t})"
    return f"(5e-1 * (1 + sign({z}) * (1 - {poly} * exp(-({z}) * ({z}) / 2))))"


@query("normal_probability", RETURNS + f""", zs AS (SELECT Ticker, Date, (r - avg(r) OVER (PARTITION BY Ticker)) / nullif(stddev_samp(r) OVER (PARTITION BY Ticker), 0) AS z FROM rr)
 SELECT Ticker, Date, {g(_cdf_sql('z'))} AS probability FROM zs""")
def _(spark, sf):
    """Chance of a return no larger than that of the day, were returns of the series normal."""
    by = Window.partitionBy("Ticker")
    z = div(F.col("r") - F.avg("r").over(by), F.stddev_samp("r").over(by))
    rows = returns(spark, sf).withColumn("_z", z)
    return publish(rows.withColumn("probability", normal_cdf(F.col("_z"))), ["Ticker", "Date"], ["probability"])


@query("qq_points", RETURNS + f""", o AS (SELECT Ticker, r, row_number() OVER (PARTITION BY Ticker ORDER BY r, Date) AS i, count(*) OVER (PARTITION BY Ticker) AS n FROM rr),
 m AS (SELECT *, CASE WHEN i = n THEN pow(5e-1, 1e0 / n) WHEN i = 1 THEN 1 - pow(5e-1, 1e0 / n) ELSE (i - 3175e-4) / (n + 365e-3) END AS p FROM o),
 t AS (SELECT *, {_quantile_sql('p')} AS theoretical FROM m),
 l AS (SELECT Ticker, regr_slope(r, theoretical) AS slope, regr_intercept(r, theoretical) AS intercept FROM t GROUP BY Ticker)
 SELECT t.Ticker, CAST(i AS INTEGER) AS i, {gcols(['theoretical', 'r', 'slope', 'intercept'])} FROM t JOIN l ON l.Ticker = t.Ticker""")
def _(spark, sf):
    return publish(stats.qq_points(returns(spark, sf)), ["Ticker", "i"], ["theoretical", "r", "slope", "intercept"])


@query("adf_fixed_lag", f"""WITH {BARS}, d AS (SELECT Date, Ticker, AdjClose - {lag('AdjClose')} AS d, {lag('AdjClose')} AS y FROM fx_bars),
 e AS (SELECT * FROM (SELECT *, {lag('d')} AS z FROM d) WHERE d IS NOT NULL AND z IS NOT NULL),
 s AS (SELECT Ticker, count(*) AS n, covar_pop(y, y) AS syy, covar_pop(z, z) AS szz, covar_pop(y, z) AS syz, covar_pop(y, d) AS syd, covar_pop(z, d) AS szd, var_pop(d) AS sdd FROM e GROUP BY Ticker),
 b AS (SELECT *, syy * szz - syz * syz AS det FROM s),
 c AS (SELECT *, (syd * szz - szd * syz) / det AS b1, (szd * syy - syd * syz) / det AS b2 FROM b),
 t AS (SELECT Ticker, n, b1 / sqrt((sdd - b1 * syd - b2 * szd) * n / (n - 3) * szz / (det * n)) AS t_stat FROM c)
 SELECT Ticker, n, {g('t_stat', 4)} AS t_stat, t_stat < -343e-2 AS reject_1pct, t_stat < -286e-2 AS reject_5pct, t_stat < -257e-2 AS reject_10pct FROM t""")
def _(spark, sf):
    return publish(stats.adf_fixed_lag(fx.bars(spark, sf), 1), ["Ticker", "n", "reject_1pct", "reject_5pct", "reject_10pct"], ["t_stat"], 4)


@query("drawdown_curve", f"""WITH {CALM}, rr AS (SELECT * FROM (SELECT Date, Ticker, {LP} - {lag(LP)} AS r FROM fx_calm) WHERE r IS NOT NULL),
 v AS (SELECT *, exp(sum(ln(1 + r)) OVER {EVER}) AS Value FROM rr)
 SELECT Date, Ticker, {g('Value')} AS Value, {g(f'Value / max(Value) OVER {EVER} - 1')} AS Drawdown FROM v""")
def _(spark, sf):
    return publish(drawdown_curve(stats.log_returns(fx.calm_bars(spark, sf)), "Ticker"), KEYS, ["Value", "Drawdown"])


@query("breadth_gauge", f"""{BASE}, w AS (SELECT Ticker, r FROM a WHERE Date >= (SELECT max(Date) FROM a) - 7),
 s AS (SELECT greatest(-100, least(100, avg(r) * 100 * 25)) AS Score, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) * 100 AS Pct_Positive, count(DISTINCT Ticker) AS Names FROM w)
 SELECT {gcols(['Score', 'Pct_Positive'])}, Names, CASE WHEN Score > 20 THEN 'Bullish' WHEN Score < -20 THEN 'Bearish' ELSE 'Neutral' END AS Label FROM s""")
def _(spark, sf):
    feats = features.series_features(fx.bars(spark, sf), only=["log_returns"])
    return publish(signals.breadth_gauge(feats), ["Names", "Label"], ["Score", "Pct_Positive"])


@query("rank_by_risk", f"""WITH {WIDE_BARS}, a AS (SELECT *, {LP} - {lag(LP)} AS r FROM fx_wide), f AS (SELECT Ticker, Date, {roll('stddev_samp', 'r', 21)} * {YEAR} AS v FROM a),
 l AS (SELECT Ticker, v FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS rn FROM f) WHERE rn = 1 AND v IS NOT NULL)
 SELECT arg_max(Ticker, v) AS most_volatile, arg_min(Ticker, v) AS least_volatile, count(*) AS names, {g('quantile_cont(v, 5e-1)')} AS median_vol FROM l""")
def _(spark, sf):
    feats = features.series_features(fx.wide_bars(spark, sf), only=["rolling_vol"])
    return publish(signals.rank_by_risk(feats), ["most_volatile", "least_volatile", "names"], ["median_vol"])


SERVING_SQL = MARKET_SQL + f""", a AS (SELECT *, {LP} - {lag(LP)} AS r FROM fx_bars),
 sv AS (SELECT a.Date, a.Ticker, r AS Return_1d, AdjClose, {roll('stddev_samp', 'r', 21).replace('Ticker', 'a.Ticker').replace('ORDER BY Date', 'ORDER BY a.Date')} * {YEAR} AS Vol_21d, VIX_Level
  FROM a LEFT JOIN ctx ON ctx.Date = a.Date)"""


@query("serving_snapshot", SERVING_SQL + f" SELECT Date, Ticker, {gcols(['Return_1d', 'AdjClose', 'Vol_21d', 'VIX_Level'])} FROM sv")
def _(spark, sf):
    from loomspan.session import run_dir
    from loomspan.sources.sinks import write_serving_copy
    feats = features.series_features(fx.bars(spark, sf), only=["log_returns", "rolling_vol"])
    path = run_dir(spark, "serving")
    write_serving_copy(context.context_join(feats, context.market_context(fx.bars(spark, sf), CFG)), path)
    return publish(spark.read.parquet(path), KEYS, ["Return_1d", "AdjClose", "Vol_21d", "VIX_Level"])

