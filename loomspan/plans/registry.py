"""Named queries: a Spark callable over a table folder and, where one exists, an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.expr import GRID_OFFSET, grid

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(fn: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn
    return register


def publish(df: DataFrame, keys: list[str], values: list[str], digits: int | dict[str, int] = 6) -> DataFrame:
    """Key columns as they are, value columns on a fixed decimal grid; digits may name those of single columns (else 6)."""
    of = digits if isinstance(digits, dict) else dict.fromkeys(values, digits)
    return df.select(*keys, *[grid(F.col(v).cast("double"), of.get(v, 6)).alias(v) for v in values])


# SQL text helpers -------------------------------------------------------------------------------

SERIES = "PARTITION BY Ticker ORDER BY Date"


def g(expr: str, digits: int = 6) -> str:
    return f"floor(({expr})*1e{digits}+{GRID_OFFSET})/1e{digits}"


def gcols(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"{g(c, digits)} AS {c}" for c in cols)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({SERIES})"


def roll(agg: str, x: str, w: int, least: int | None = None) -> str:
    frame = f"({SERIES} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {frame} >= {w if least is None else least} THEN {agg}({x}) OVER {frame} END)"


def over0(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


# Fixture statements, the SQL side of loomspan.sources.fixtures -------------------------------------

def _bars(ticker: str) -> str:
    return f"""(
 SELECT Date, Ticker, max(CASE WHEN rn = 1 THEN px END) AS Open, max(px) AS High, min(px) AS Low,
  max(CASE WHEN rn = n THEN px END) AS Close,
  max(CASE WHEN rn = n THEN px END) * (1 - avg(d)) AS AdjClose, sum(q) AS Volume
 FROM (SELECT CAST(l_shipdate AS DATE) AS Date, {ticker} AS Ticker, l_extendedprice / 1e3 AS px,
  l_quantity AS q, l_discount AS d,
  row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), {ticker}
   ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
  count(*) OVER (PARTITION BY CAST(l_shipdate AS DATE), {ticker}) AS n FROM lineitem) t
 GROUP BY Date, Ticker)"""


BARS = f"fx_bars AS {_bars('concat(l_returnflag, l_linestatus)')}"
WIDE_BARS = f"fx_wide AS {_bars('CAST(l_suppkey AS VARCHAR)')}"
MARKET_WIDE = """fx_market AS (SELECT * FROM fx_wide UNION ALL
 SELECT Date, 'MARKET', avg(Open), avg(High), avg(Low), avg(Close), avg(AdjClose), sum(Volume) FROM fx_wide GROUP BY Date)"""
CALM = BARS + """, fx_calm AS (SELECT Date, Ticker, Open, High, Low, Close, 100 * pow(AdjClose, 2e-2) AS AdjClose, Volume FROM fx_bars)"""
SPARSE = """fx_sparse AS (
 SELECT CAST(o_orderdate AS DATE) AS Date, o_orderpriority AS Ticker, arg_min(o_totalprice / 1e3, o_orderkey) AS Open,
  max(o_totalprice / 1e3) AS High, min(o_totalprice / 1e3) AS Low, arg_max(o_totalprice / 1e3, o_orderkey) AS Close,
  arg_max(o_totalprice / 1e3, o_orderkey) AS AdjClose, CAST(count(*) AS DOUBLE) AS Volume
 FROM orders GROUP BY 1, 2)"""
RAW = SPARSE + """, fx_raw AS (
 SELECT * FROM fx_sparse UNION ALL
 SELECT Date, Ticker, Open, High, Low, Close + 1, NULL, Volume FROM fx_sparse WHERE day(Date) = 1)"""
BAD = BARS + """, fx_bad AS (
 SELECT Date, Ticker, Open, High, CASE WHEN day(Date) = 13 THEN High + 1 ELSE Low END AS Low, Close, AdjClose, Volume FROM fx_bars)"""
MACRO = """fx_macro AS (
 SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Date, o_orderstatus AS Series, avg(o_totalprice) / 1e3 AS Value
 FROM orders GROUP BY 1, 2)"""
NEWS_CAL = """fx_cal AS (SELECT DISTINCT CAST(ts AS DATE) AS Date FROM events WHERE isodow(ts) <= 5)"""
NEWS = r"""fx_news AS (
 SELECT doc_id AS ArticleId, event_id AS EventId, event_type AS Ticker, ts AS Timestamp, regexp_extract(text, '^[^.\n]*') AS Headline,
  substring(text, length(regexp_extract(text, '^[^.\n]*')) + 2) AS Summary, n_chars
 FROM (SELECT documents.*, doc_id * 7919 % n AS number FROM documents, (SELECT count(*) AS n FROM events)) JOIN events ON number = event_id)"""
def _predictions(fixture: str, src: str) -> str:
    return fixture + f""", fx_r AS (
 SELECT Date, Ticker, AdjClose, ln(AdjClose) - {lag('ln(AdjClose)')} AS r,
  lead(ln(AdjClose)) OVER ({SERIES}) - ln(AdjClose) AS Actual_Return FROM {src}),
 fx_pred AS (SELECT Date, Ticker, AdjClose, Actual_Return, Model, r * c AS Predicted_Return
 FROM fx_r, (VALUES ('mom', 1e-1), ('rev', -1e-1), ('zero', 0e0)) m(Model, c) WHERE r IS NOT NULL AND Actual_Return IS NOT NULL)"""


PREDICTIONS = _predictions(BARS, "fx_bars")
WIDE_PREDICTIONS = _predictions(WIDE_BARS, "fx_wide")
CALM_PREDICTIONS = _predictions(CALM, "fx_calm")
BAR_SENTIMENT = "fx_sent AS (SELECT Date, Ticker, coalesce((Close - Open) / nullif(High - Low, 0), 0) AS Sentiment_FinBERT FROM fx_bars)"
WEIGHTS = "fx_weights AS (SELECT * FROM (VALUES ('AF', 4e-1, 25e-2), ('AO', 3e-1, 25e-2), ('NF', 2e-1, 25e-2), ('RF', 1e-1, 25e-2)) w(Ticker, Target_Weight, Current_Weight))"
ALIGNED = """al_cal AS (SELECT DISTINCT Date FROM {src} WHERE Ticker = '{bench}'), al_tick AS (SELECT DISTINCT Ticker FROM {src}),
 aligned AS (SELECT c.Date, t.Ticker, p.Open, p.High, p.Low, p.Close, p.AdjClose, p.Volume
  FROM al_cal c CROSS JOIN al_tick t LEFT JOIN {src} p ON p.Date = c.Date AND p.Ticker = t.Ticker)"""


def aligned(src: str, bench: str) -> str:
    return ALIGNED.format(src=src, bench=bench)


def _fill(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


IMPUTED = ("imputed AS (SELECT Date, Ticker, " + ", ".join(f"{_fill(c)} AS {c}" for c in ("Open", "High", "Low", "Close", "AdjClose"))
           + f", coalesce({_fill('Volume')}, 0) AS Volume, Close IS NULL AS Missing, row_number() OVER ({SERIES}) - 1 AS idx FROM aligned)")
FLAGGED = f"""ret AS (SELECT *, ln(AdjClose) - {lag('ln(AdjClose)')} AS Ret FROM imputed),
 zs AS (SELECT *, {over0(f"Ret - {roll('avg', 'Ret', 63, 21)}", roll('stddev_samp', 'Ret', 63, 21))} AS Z_Score FROM ret),
 qt AS (SELECT Ticker, quantile_cont(Ret, 25e-2) AS q1, quantile_cont(Ret, 75e-2) AS q3 FROM ret GROUP BY Ticker),
 flagged AS (SELECT zs.*, coalesce(abs(Z_Score) > 5, false) AS Outlier_Z,
  coalesce(Ret < q1 - 15e-1 * (q3 - q1) OR Ret > q3 + 15e-1 * (q3 - q1), false) AS Outlier_IQR
  FROM zs JOIN qt USING (Ticker))"""
