"""Registered queries: sources, sinks, filters, reshapes, cleaning and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.expr import TIME
from loomspan.functions.text import concat_text, contains_any_case
from loomspan.operators import checks, cleaning, context, features, labels, models, signals
from loomspan.operators.portfolio import recent_rows
from loomspan.operators.sentiment import coverage_gap
from loomspan.plans.registry import (BAD, BARS, FLAGGED, IMPUTED, MACRO, NEWS, PREDICTIONS, RAW, SERIES, SPARSE,
                                     MARKET_WIDE, WIDE_BARS, aligned, g, gcols, lag, publish, query, roll)
from loomspan.session import run_dir
from loomspan.sources import fixtures as fx
from loomspan.sources import readers, sinks

KEYS = ["Date", "Ticker"]
FIELDS = list(readers.PRICE_FIELDS)
BAR_TICKERS = ["AF", "AO", "NF", "NO", "RF", "RO"]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
          "embeddings", "pages", "benchmark", "conversations")
CALENDAR = fx.SPARSE_CONFIG.benchmark
SPARSE_ALIGNED = f"WITH {SPARSE}, {aligned('fx_sparse', CALENDAR)}"


def wide_frame(panel, tickers, fields):
    return panel.groupBy("Date").agg(*[
        F.max(F.when(F.col("Ticker") == t, F.col(f))).alias(f"{f}|{t}") for t in tickers for f in fields])


# sources and sinks -------------------------------------------------------------------------------

@query("ohlcv_unpivot", f"WITH {BARS} SELECT Date, Ticker, {gcols(FIELDS)} FROM fx_bars")
def _(spark, sf):
    return publish(readers.unpivot_ohlcv(wide_frame(fx.bars(spark, sf), BAR_TICKERS, FIELDS)), KEYS, FIELDS)


@query("scan_panel", f"WITH {BARS} SELECT Date, Ticker, {gcols(FIELDS)} FROM fx_bars")
def _(spark, sf):
    return publish(readers.scan_panel(fx.bars(spark, sf)), KEYS, FIELDS)


@query("scan_macro", f"WITH {MACRO} SELECT Date, Series, {g('Value')} AS Value FROM fx_macro")
def _(spark, sf):
    wide = fx.macro(spark, sf).groupBy("Date").pivot("Series", ["F", "O", "P"]).agg(F.first("Value"))
    return publish(readers.scan_macro(wide), ["Date", "Series"], ["Value"])


@query("sink_parquet", f"""WITH {BARS} SELECT Ticker, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT year(Date)) AS BIGINT) AS years,
 {g('sum(Volume)', 3)} AS volume FROM fx_bars GROUP BY Ticker""")
def _(spark, sf):
    path = run_dir(spark, "sink-parquet")
    sinks.write_yearly(fx.bars(spark, sf), path)
    back = spark.read.parquet(path)
    out = back.groupBy("Ticker").agg(F.count("*").alias("n_rows"), F.countDistinct("year").alias("years"),
                                     F.sum("Volume").alias("volume"))
    return publish(out, ["Ticker", "n_rows", "years"], ["volume"], 3)


@query("scan_csv", f"WITH {BARS} SELECT Ticker, CAST(count(*) AS BIGINT) AS n_rows, {g('max(High)', 3)} AS high FROM fx_bars GROUP BY Ticker")
def _(spark, sf):
    path = run_dir(spark, "scan-csv")
    out = fx.bars(spark, sf).groupBy("Ticker").agg(F.count("*").alias("n_rows"), F.max("High").alias("high"))
    sinks.write_csv(out.withColumnRenamed("Ticker", "Unnamed: 0"), path)
    return publish(readers.scan_csv(spark, path, "`Unnamed: 0` string, n_rows long, high double", "Ticker"),
                   ["Ticker", "n_rows"], ["high"], 3)


@query("sink_csv", f"WITH {BARS} SELECT Ticker, {g('avg(Close)', 4)} AS mean_close, {g('min(Low)', 4)} AS low FROM fx_bars GROUP BY Ticker")
def _(spark, sf):
    path = run_dir(spark, "sink-csv")
    sinks.write_csv(fx.bars(spark, sf).groupBy("Ticker").agg(F.avg("Close").alias("mean_close"), F.min("Low").alias("low")), path)
    return publish(spark.read.csv(path, header=True, schema="Ticker string, mean_close double, low double"),
                   ["Ticker"], ["mean_close", "low"], 4)


@query("scan_json", f"WITH {BARS} SELECT Ticker, CAST(count(*) AS BIGINT) AS sessions, CAST(min(Date) AS VARCHAR) AS first_date FROM fx_bars GROUP BY Ticker")
def _(spark, sf):
    path = run_dir(spark, "scan-json")
    per = fx.bars(spark, sf).groupBy("Ticker").agg(F.count("*").alias("sessions"), F.min("Date").cast("string").alias("first"))
    doc = per.agg(F.to_json(F.collect_list(F.struct("Ticker", F.struct("sessions", "first").alias("span")))).alias("value"))
    doc.write.text(path)
    back = readers.scan_json(spark, path, "Ticker string, span struct<sessions: long, first: string>")
    return back.select("Ticker", F.col("span.sessions").alias("sessions"), F.col("span.first").alias("first_date"))


def news_chunks(spark, sf):
    """News as chunk documents of at most 250 articles."""
    article = F.struct(
        F.col("Headline").alias("title"),
        F.concat(F.lit("https://news.example/"), F.col("ArticleId").cast("string")).alias("url"),
        F.date_format("Timestamp", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    news = fx.news(spark, sf).withColumn("_chunk", F.floor(F.col("ArticleId") / 250))
    return news.groupBy(F.col("Ticker").alias("ticker"), "_chunk").agg(
        F.min(F.to_date("Timestamp")).cast("string").alias("start"), F.max(F.to_date("Timestamp")).cast("string").alias("end"),
        F.collect_list(article).alias("articles")).drop("_chunk")


@query("news_json_ingest", f"""WITH {NEWS} SELECT Ticker, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS seen, trim(Headline) AS Headline,
 concat('https://news.example/', CAST(ArticleId AS VARCHAR)) AS ArticleKey FROM fx_news WHERE length(trim(Headline)) > 0""")
def _(spark, sf):
    path = run_dir(spark, "news-chunks")
    sinks.write_json(news_chunks(spark, sf), path)
    rows = readers.read_news_chunks(spark, path)
    return rows.select("Ticker", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("seen"), "Headline", "ArticleKey")


@query("news_epoch_ingest", f"""WITH {NEWS} SELECT Ticker, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS seen, trim(Headline) AS Headline,
 length(trim(Summary)) AS summary_chars FROM fx_news WHERE length(trim(Headline)) > 0 OR length(trim(Summary)) > 0""")
def _(spark, sf):
    raw = fx.news(spark, sf).select(
        F.col("Ticker").alias("ticker"), F.col("Headline").alias("headline"), F.col("Summary").alias("summary"),
        F.unix_seconds(F.col("Timestamp").cast("timestamp")).alias("datetime"))
    out = readers.shape_epoch_news(raw)
    return out.select("Ticker", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("seen"), "Headline",
                      F.length("Summary").cast("long").alias("summary_chars"))


@query("date_normalise", f"WITH {BARS} SELECT Date, Ticker, {g('Close')} AS Close FROM fx_bars")
def _(spark, sf):
    unnamed = fx.bars(spark, sf).select("Ticker", F.col("Date").cast("timestamp").alias("__index_level_0__"), "Close")
    return publish(readers.normalise_date(unnamed), KEYS, ["Close"])


@query("table_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS artifact, true AS present, count(*) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT) AS n_columns FROM {t}"
    for t in TABLES))
def _(spark, sf):
    return sinks.table_profile({t: readers.table(spark, sf, t) for t in TABLES}).select(
        "artifact", "present", F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns"))


@query("date_chunks", """SELECT CAST(s AS DATE) AS Start, least(CAST(s AS DATE) + 119, hi) AS Stop FROM
 (SELECT unnest(generate_series(lo, hi, INTERVAL 120 DAY)) AS s, hi FROM
  (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders))""")
def _(spark, sf):
    bounds = readers.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return readers.date_spans(bounds, 120)


# filters -------------------------------------------------------------------------------------------

@query("filter_universe", f"WITH {BARS} SELECT Date, Ticker, {g('AdjClose')} AS AdjClose FROM fx_bars WHERE Ticker IN ('AF','AO','NF','RF')")
def _(spark, sf):
    return publish(fx.bars(spark, sf).where(F.col("Ticker").isin(list(fx.BARS_CONFIG.universe))), KEYS, ["AdjClose"])


@query("drop_unusable", f"{SPARSE_ALIGNED}, {IMPUTED} SELECT Date, Ticker, {gcols(['Close', 'AdjClose'])} FROM imputed WHERE Close IS NOT NULL AND AdjClose IS NOT NULL")
def _(spark, sf):
    return publish(cleaning.drop_unusable(cleaning.impute_gaps(cleaning.align_calendar(fx.sparse_bars(spark, sf), CALENDAR))),
                   KEYS, ["Close", "AdjClose"])


@query("inf_to_null", f"""WITH {BARS} SELECT Date, Ticker, CASE WHEN day(Date) IN (7, 13, 21) THEN NULL ELSE {g('Close')} END AS Close,
 {g('Volume')} AS Volume FROM fx_bars""")
def _(spark, sf):
    day = F.dayofmonth("Date")
    spoiled = fx.bars(spark, sf).withColumn(
        "Close", F.when(day == 7, float("nan")).when(day == 13, float("inf")).when(day == 21, float("-inf")).otherwise(F.col("Close")))
    return publish(features.inf_to_null(spoiled), KEYS, ["Close", "Volume"])


REQUIRED = ["Return_5d", "SMA_20", "Vol_21d"]
REQUIRED_SQL = f"""WITH {BARS}, a AS (SELECT *, ln(AdjClose) - {lag('ln(AdjClose)')} AS r FROM fx_bars),
 f AS (SELECT Date, Ticker, ln(AdjClose) - {lag('ln(AdjClose)', 5)} AS Return_5d, {roll('avg', 'AdjClose', 20)} AS SMA_20,
  {roll('stddev_samp', 'r', 21)} * sqrt(252) AS Vol_21d, lead(ln(AdjClose)) OVER ({SERIES}) - ln(AdjClose) AS Target FROM a)"""


def _required(spark, sf):
    feats = features.series_features(fx.bars(spark, sf), only=["log_returns", "sma", "rolling_vol"])
    return features.forward_target(feats).select(*KEYS, "AdjClose", *REQUIRED, "Target")


@query("null_report", REQUIRED_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", count(*) - count({c}) AS Nulls FROM f" for c in [*REQUIRED, "Target"]))
def _(spark, sf):
    return features.null_report(_required(spark, sf), [*REQUIRED, "Target"])


@query("drop_missing_features", REQUIRED_SQL + f" SELECT Date, Ticker, {gcols([*REQUIRED, 'Target'])} FROM f WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in [*REQUIRED, "Target"]))
def _(spark, sf):
    return publish(features.drop_missing(_required(spark, sf), REQUIRED), KEYS, [*REQUIRED, "Target"])


AFFINE_SQL = """WITH m AS (SELECT row_number() OVER () AS r, embedding AS e FROM embeddings),
 u AS (SELECT r, concat('e', CAST(i AS VARCHAR)) AS c, CAST(e[i + 1] AS DOUBLE) AS v FROM m, range(64) t(i)
  UNION ALL SELECT r, 'z_copy', 2 * CAST(e[1] AS DOUBLE) + 5 FROM m),
 f AS (SELECT a.c AS x, b.c AS y, regr_slope(b.v, a.v) AS s, regr_intercept(b.v, a.v) AS l, max(CASE WHEN a.v IS NOT NULL THEN abs(b.v) END) AS size
  FROM u a JOIN u b ON a.r = b.r AND a.c < b.c GROUP BY a.c, b.c),
 q AS (SELECT f.x, f.y, max(abs(b.v - a.v * s - l)) / greatest(1, any_value(size)) AS worst
  FROM f JOIN u a ON a.c = f.x JOIN u b ON b.c = f.y AND b.r = a.r GROUP BY f.x, f.y),
 gone AS (SELECT DISTINCT y AS c FROM q WHERE worst < 1e-8)"""


@query("feature_select", AFFINE_SQL + """ SELECT DISTINCT c AS "Column" FROM u WHERE c NOT IN (SELECT c FROM gone)""")
def _(spark, sf):
    m = fx.embedding_matrix(spark, sf).drop("vec_id")
    kept = models.collinearity_filter(m, sorted(features.numeric_columns(m)))
    return spark.createDataFrame([(c,) for c in kept], "`Column` string")


@query("collinearity_filter", AFFINE_SQL + " SELECT c AS Dropped FROM gone")
def _(spark, sf):
    m = fx.embedding_matrix(spark, sf)
    cols = sorted(features.numeric_columns(m.drop("vec_id")))
    gone = sorted(set(cols) - set(models.collinearity_filter(m, cols)))
    return spark.createDataFrame([(c,) for c in gone], "Dropped string")


@query("date_tail_filter", f"WITH {BARS} SELECT Date, Ticker, {g('Close')} AS Close FROM fx_bars WHERE Date >= (SELECT max(Date) FROM fx_bars) - 45")
def _(spark, sf):
    return publish(recent_rows(fx.bars(spark, sf), 45), KEYS, ["Close"])


@query("threshold_action", f"""WITH {PREDICTIONS} SELECT Date, Ticker, Model, CASE WHEN Predicted_Return >= 15e-2 THEN 'BUY'
 WHEN Predicted_Return <= -15e-2 THEN 'SELL' ELSE 'HOLD' END AS Action FROM fx_pred""")
def _(spark, sf):
    p = fx.predictions(spark, sf)
    return p.select("Date", "Ticker", "Model", signals.threshold_action(F.col("Predicted_Return"), -0.15, 0.15).alias("Action"))


@query("mood_label", f"""WITH {PREDICTIONS} SELECT Date, Ticker, CASE WHEN Actual_Return > 15e-2 THEN 'Bullish'
 WHEN Actual_Return < -15e-2 THEN 'Bearish' ELSE 'Neutral' END AS Mood FROM fx_pred WHERE Model = 'zero'""")
def _(spark, sf):
    from loomspan.functions.text import mood_label
    p = fx.predictions(spark, sf).where("Model = 'zero'")
    return p.select("Date", "Ticker", mood_label(F.col("Actual_Return"), 0.15, -0.15).alias("Mood"))


@query("rebased_price", f"""WITH {BARS} SELECT Date, Ticker,
 {g(f'AdjClose / first_value(AdjClose) OVER ({SERIES})')} AS Rebased FROM fx_bars""")
def _(spark, sf):
    return publish(context.rebased_price(fx.bars(spark, sf)), KEYS, ["Rebased"])


@query("text_contains", f"""WITH {NEWS} SELECT ArticleId, contains(lower(Headline), 'the') AS Here FROM fx_news""")
def _(spark, sf):
    """Headlines with a term in any case."""
    return fx.news(spark, sf).select("ArticleId", contains_any_case(F.col("Headline"), "ThE").alias("Here"))


@query("concat_text", f"""WITH {NEWS} SELECT ArticleId, trim(concat(coalesce(Headline, ''), '. ', coalesce(Summary, ''))) AS Text FROM fx_news""")
def _(spark, sf):
    return fx.news(spark, sf).select("ArticleId", concat_text(F.col("Headline"), F.col("Summary")).alias("Text"))


# reshape -------------------------------------------------------------------------------------------

@query("pivot_prices", f"WITH {BARS} SELECT Date, " + ", ".join(
    g(f"max(CASE WHEN Ticker = '{t}' THEN AdjClose END)") + f" AS {t}" for t in BAR_TICKERS) + " FROM fx_bars GROUP BY Date")
def _(spark, sf):
    return publish(cleaning.pivot_prices(fx.bars(spark, sf), BAR_TICKERS), ["Date"], BAR_TICKERS)


MELT = ["Open", "Close", "Volume"]


@query("melt_panel", f"""WITH {BARS}, d AS (SELECT DISTINCT Date FROM fx_bars), t AS (SELECT DISTINCT Ticker FROM fx_bars)
 SELECT d.Date, t.Ticker, {gcols(MELT)}, coalesce(Volume > 50, false) AS Busy FROM d CROSS JOIN t
 LEFT JOIN fx_bars b ON b.Date = d.Date AND b.Ticker = t.Ticker""")
def _(spark, sf):
    flagged = fx.bars(spark, sf).withColumn("Busy", F.col("Volume") > 50)
    wide = wide_frame(flagged, BAR_TICKERS, [*MELT, "Busy"])
    return publish(cleaning.melt_panel(wide, BAR_TICKERS, MELT, ["Busy"]), [*KEYS, "Busy"], MELT)


@query("melt_fields", f"WITH {BARS} " + " UNION ALL ".join(
    f"SELECT Date, Ticker, '{c}' AS Field, {g(c)} AS Value FROM fx_bars" for c in FIELDS))
def _(spark, sf):
    return publish(cleaning.melt_fields(fx.bars(spark, sf)), [*KEYS, "Field"], ["Value"])


MONTH_SQL = f"""WITH {BARS}, r AS (SELECT Date, Ticker, ln(AdjClose) - {lag('ln(AdjClose)')} AS r FROM fx_bars),
 p AS (SELECT year(Date) AS yr, month(Date) AS mon, Ticker, avg(r) AS v FROM r GROUP BY 1, 2, 3),
 s AS (SELECT yr, mon, avg(v) AS v FROM p GROUP BY 1, 2)"""


@query("seasonal_matrix", MONTH_SQL + " SELECT CAST(yr AS INTEGER) AS Year, " + ", ".join(
    g(f"max(CASE WHEN mon = {k} THEN v END)") + f" AS m{k:02d}" for k in range(1, 13)) + " FROM s GROUP BY yr")
def _(spark, sf):
    return publish(signals.seasonal_matrix(fx.bars(spark, sf)), ["Year"], [f"m{k:02d}" for k in range(1, 13)])


@query("seasonal_extremes", MONTH_SQL + """, a AS (SELECT mon, avg(v) AS v FROM s GROUP BY mon)
 SELECT CAST(arg_max(mon, v) AS INTEGER) AS best_month, CAST(arg_min(mon, v) AS INTEGER) AS worst_month FROM a""")
def _(spark, sf):
    return signals.seasonal_extremes(fx.bars(spark, sf))


# cleaning ------------------------------------------------------------------------------------------

@query("dedup_best_record", f"""WITH {RAW}, k AS (SELECT *, row_number() OVER (PARTITION BY Date, Ticker ORDER BY
 CASE WHEN AdjClose IS NULL THEN 1 ELSE 0 END, Close DESC) AS rn FROM fx_raw)
 SELECT Date, Ticker, {gcols(FIELDS)} FROM k WHERE rn = 1""")
def _(spark, sf):
    return publish(cleaning.dedup_best_record(fx.raw_with_repeats(spark, sf)), KEYS, FIELDS)


CONFLICTS = f"""WITH {RAW}, c AS (SELECT Date, Ticker, count(*) AS Copies, 'Close,AdjClose' AS Differing FROM fx_raw GROUP BY 1, 2
 HAVING count(*) > 1 AND count(DISTINCT Close) > 1 AND count(AdjClose) < count(*)
 AND count(DISTINCT Open) = 1 AND count(DISTINCT High) = 1 AND count(DISTINCT Low) = 1 AND count(DISTINCT Volume) = 1)"""


@query("duplicate_conflicts", CONFLICTS + " SELECT * FROM c")
def _(spark, sf):
    return cleaning.duplicate_conflicts(fx.raw_with_repeats(spark, sf))


@query("conflict_limit", CONFLICTS + " SELECT * FROM c ORDER BY Date, Ticker LIMIT 20")
def _(spark, sf):
    return cleaning.conflict_details(cleaning.duplicate_conflicts(fx.raw_with_repeats(spark, sf)), 20)


@query("calendar_align", f"{SPARSE_ALIGNED} SELECT Date, Ticker, {gcols(FIELDS)} FROM aligned")
def _(spark, sf):
    return publish(cleaning.align_calendar(fx.sparse_bars(spark, sf), CALENDAR), KEYS, FIELDS)


@query("calendar_align_many", f"WITH {WIDE_BARS}, {MARKET_WIDE}, {aligned('fx_market', 'MARKET')} SELECT Date, Ticker, {gcols(FIELDS)} FROM aligned")
def _(spark, sf):
    """All supplier series on the days on which any of them trades."""
    return publish(cleaning.align_calendar(fx.with_market(fx.wide_bars(spark, sf)), fx.MARKET), KEYS, FIELDS)


@query("limited_ffill", f"{SPARSE_ALIGNED}, {IMPUTED} SELECT Date, Ticker, {gcols(FIELDS)} FROM imputed")
def _(spark, sf):
    return publish(cleaning.impute_gaps(cleaning.align_calendar(fx.sparse_bars(spark, sf), CALENDAR)), KEYS, FIELDS)


def _imputed(spark, sf):
    return cleaning.impute_gaps(cleaning.align_calendar(fx.sparse_bars(spark, sf), CALENDAR))


GAPS = """SELECT Ticker, CAST(sum(CASE WHEN Missing THEN 1 ELSE 0 END) AS BIGINT) AS missing_before,
 CAST(sum(CASE WHEN Missing AND Close IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled,
 CAST(sum(CASE WHEN Close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS remaining,
 CAST(sum(CASE WHEN Missing AND idx <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS "leading" FROM imputed GROUP BY Ticker"""


@query("gap_accounting", f"{SPARSE_ALIGNED}, {IMPUTED} {GAPS}")
def _(spark, sf):
    return cleaning.gap_accounting(_imputed(spark, sf))


@query("sink_report_rows", f"""{SPARSE_ALIGNED}, {IMPUTED}, gaps AS ({GAPS}) SELECT Ticker, concat('{{"filled":', filled, ',"leading":', "leading",
 ',"missing_before":', missing_before, ',"remaining":', remaining, '}}') AS report FROM gaps""")
def _(spark, sf):
    return sinks.report_rows(cleaning.gap_accounting(_imputed(spark, sf)), "Ticker")


@query("rolling_zscore", f"{SPARSE_ALIGNED}, {IMPUTED}, {FLAGGED} SELECT Date, Ticker, {g('Ret')} AS Return, {g('Z_Score')} AS Z_Score, Outlier_Z FROM flagged")
def _(spark, sf):
    return publish(cleaning.rolling_zscore(_imputed(spark, sf)), [*KEYS, "Outlier_Z"], ["Return", "Z_Score"])


@query("iqr_fence", f"{SPARSE_ALIGNED}, {IMPUTED}, {FLAGGED} SELECT Date, Ticker, Outlier_IQR, Outlier_IQR OR Outlier_Z AS Outlier FROM flagged")
def _(spark, sf):
    return cleaning.flag_outliers(_imputed(spark, sf)).select(*KEYS, "Outlier_IQR", "Outlier")


@query("outlier_summary", f"""{SPARSE_ALIGNED}, {IMPUTED}, {FLAGGED} SELECT coalesce(Ticker, 'ALL') AS Ticker,
 CAST(sum(CAST(Outlier_Z AS INT)) AS BIGINT) AS zscore, CAST(sum(CAST(Outlier_IQR AS INT)) AS BIGINT) AS iqr,
 CAST(sum(CAST(Outlier_IQR OR Outlier_Z AS INT)) AS BIGINT) AS either, count(*) AS retained FROM flagged GROUP BY ROLLUP (Ticker)""")
def _(spark, sf):
    return cleaning.outlier_summary(cleaning.flag_outliers(_imputed(spark, sf)))


VIOLATION = "Close IS NOT NULL AND (Low > least(Open, Close, High) OR High < greatest(Open, Close, Low))"


@query("ohlc_invariant", f"WITH {BAD} SELECT Date, Ticker, " + ", ".join(
    f"CASE WHEN {VIOLATION} THEN NULL ELSE {g(c)} END AS {c}" for c in FIELDS) + " FROM fx_bad")
def _(spark, sf):
    return publish(cleaning.quarantine(fx.bad_ohlc(spark, sf)), KEYS, FIELDS)


@query("ohlc_violations", f"WITH {BAD} SELECT Date, Ticker, {gcols(['Open', 'High', 'Low', 'Close'])} FROM fx_bad WHERE {VIOLATION}")
def _(spark, sf):
    return publish(cleaning.ohlc_violations(fx.bad_ohlc(spark, sf)), KEYS, ["Open", "High", "Low", "Close"])


CLEAN_SQL = f"""WITH {RAW}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Date, Ticker ORDER BY
 CASE WHEN AdjClose IS NULL THEN 1 ELSE 0 END, Close DESC) AS rn FROM fx_raw) WHERE rn = 1), {aligned('best', CALENDAR)}, {IMPUTED}, {FLAGGED},
 cleaned AS (SELECT Date, Ticker, Open, High, Low, Close, AdjClose, Volume, Ret, Z_Score, Outlier_Z, Outlier_IQR FROM flagged
  WHERE NOT ({VIOLATION}) AND Close IS NOT NULL AND AdjClose IS NOT NULL)"""


@query("clean_panel", CLEAN_SQL + f" SELECT Date, Ticker, {gcols(FIELDS)}, {g('Z_Score')} AS Z_Score, Outlier_Z, Outlier_IQR FROM cleaned")
def _(spark, sf):
    return publish(cleaning.clean(fx.raw_with_repeats(spark, sf), CALENDAR), [*KEYS, "Outlier_Z", "Outlier_IQR"], [*FIELDS, "Z_Score"])


@query("dq_row_accounting", CLEAN_SQL + f""", i AS (SELECT count(*) AS rows_in, count(DISTINCT (Date, Ticker)) AS keys_in FROM fx_raw),
 o AS (SELECT count(*) AS rows_out, count(DISTINCT Date) AS sessions, count(DISTINCT Ticker) AS tickers FROM cleaned)
 SELECT rows_in, rows_out, rows_in - keys_in AS duplicates, sessions, tickers, {g('(rows_out - rows_in) * 100e0 / rows_in')} AS pct_change FROM i, o""")
def _(spark, sf):
    raw = fx.raw_with_repeats(spark, sf)
    return publish(cleaning.dq_row_accounting(raw, cleaning.clean(raw, CALENDAR)),
                   ["rows_in", "rows_out", "duplicates", "sessions", "tickers"], ["pct_change"])


ASOF_SQL = f"""WITH {BARS}, {MACRO}, c AS (SELECT DISTINCT Date FROM fx_bars WHERE Ticker = 'NO'), s AS (SELECT DISTINCT Series FROM fx_macro),
 grid AS (SELECT Date, Series FROM c CROSS JOIN s),
 known AS (SELECT grid.Date, grid.Series, m.Value FROM grid ASOF LEFT JOIN fx_macro m ON m.Series = grid.Series AND m.Date <= grid.Date)"""


def macro_grid(spark, sf):
    return cleaning.asof_backward(fx.macro(spark, sf), cleaning.trading_calendar(fx.bars(spark, sf), fx.BARS_CONFIG.benchmark))


@query("asof_backward_macro", ASOF_SQL + f" SELECT Date, Series, {g('Value')} AS Value FROM known")
def _(spark, sf):
    return publish(macro_grid(spark, sf), ["Date", "Series"], ["Value"])


@query("index_union", f"WITH {BARS}, {MACRO} SELECT Date FROM fx_bars WHERE Ticker = 'NO' UNION SELECT Date FROM fx_macro")
def _(spark, sf):
    return cleaning.key_union(fx.bars(spark, sf).where("Ticker = 'NO'"), fx.macro(spark, sf))


@query("flag_join", f"""{SPARSE_ALIGNED}, {IMPUTED}, {FLAGGED} SELECT s.Date, s.Ticker, {g('s.Close')} AS Close, coalesce(f.Outlier_Z, false) AS Outlier_Z
 FROM fx_sparse s LEFT JOIN flagged f ON f.Date = s.Date AND f.Ticker = s.Ticker""")
def _(spark, sf):
    flags = cleaning.flag_outliers(_imputed(spark, sf)).select(*KEYS, "Outlier_Z")
    out = fx.sparse_bars(spark, sf).join(flags, KEYS, "left").withColumn("Outlier_Z", F.coalesce("Outlier_Z", F.lit(False)))
    return publish(out, [*KEYS, "Outlier_Z"], ["Close"])


@query("coverage_gap", f"""WITH {NEWS}, u AS (SELECT r_name AS Ticker FROM region UNION SELECT DISTINCT event_type FROM events)
 SELECT Ticker FROM u WHERE Ticker NOT IN (SELECT Ticker FROM fx_news)""")
def _(spark, sf):
    names = readers.table(spark, sf, "region").select(F.col("r_name").alias("Ticker")).union(
        readers.table(spark, sf, "events").select("event_type")).distinct()
    return coverage_gap(names, fx.news(spark, sf))


@query("distinct_articles", f"""WITH {NEWS}, twice AS (SELECT * FROM fx_news UNION ALL SELECT * FROM fx_news)
 SELECT Ticker, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS seen, trim(Headline) AS Headline,
 min(concat('https://news.example/', CAST(ArticleId AS VARCHAR))) AS ArticleKey FROM twice WHERE length(trim(Headline)) > 0 GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = readers.shape_news_chunks(news_chunks(spark, sf))
    out = readers.distinct_articles(rows.unionByName(rows))
    return out.select("Ticker", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("seen"), "Headline", "ArticleKey")


# integrity -----------------------------------------------------------------------------------------

PROBED = ["Return_5d", "SMA_20", "Vol_21d", "OBV", "EMA_12", "MACD_Signal", "Drawdown_From_Peak"]


def _probe_build(panel):
    return features.series_features(panel, only=["log_returns", "sma", "rolling_vol", "obv", "ema", "macd", "drawdown_state"])


PROBE_SQL = f"WITH {BARS}, c AS (SELECT max(Date) - 400 AS cut FROM fx_bars) SELECT col AS \"Column\", (SELECT count(*) FROM fx_bars, c WHERE Date <= cut) AS n_rows, CAST(0 AS BIGINT) AS Mismatches FROM (VALUES " + ", ".join(f"('{c}')" for c in PROBED) + ") v(col)"


def _cutoff(panel):
    return F.date_sub(panel.agg(F.max("Date").alias("d")).scalar(), 400)


@query("truncation_probe", PROBE_SQL)
def _(spark, sf):
    p = fx.bars(spark, sf)
    return checks.truncation_probe(p, _probe_build, _cutoff(p), PROBED).withColumnRenamed("rows", "n_rows")


@query("corruption_probe", PROBE_SQL)
def _(spark, sf):
    p = fx.bars(spark, sf)
    return checks.corruption_probe(p, _probe_build, _cutoff(p), PROBED, FIELDS).withColumnRenamed("rows", "n_rows")


EMB = [f"e{i}" for i in range(64)]
EMB_SQL = "m AS (SELECT vec_id, CAST(label AS DOUBLE) AS Target, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings)"


@query("label_leak_guard", f"WITH {EMB_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", {g(f'corr({c}, Target)')} AS Corr, count(*) AS Pairs, count(*) >= 200 AND abs(corr({c}, Target)) > 99e-2 AS Leaks FROM m"
    for c in EMB))
def _(spark, sf):
    return publish(checks.label_leak_guard(fx.embedding_matrix(spark, sf), EMB), ["Column", "Pairs", "Leaks"], ["Corr"])


@query("whole_sample_norm_guard", f"WITH {EMB_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", {g(f'avg({c})')} AS Mean, {g(f'stddev_samp({c})')} AS Std, count(*) >= 100 AND abs(avg({c})) < 1e-6 AND stddev_samp({c}) BETWEEN 9e-1 AND 11e-1 AS Normalised FROM m"
    for c in EMB))
def _(spark, sf):
    return publish(checks.whole_sample_norm_guard(fx.embedding_matrix(spark, sf), EMB), ["Column", "Normalised"], ["Mean", "Std"])


@query("constant_column_guard", f"WITH {EMB_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", count(DISTINCT {c}) <= 1 AS Constant FROM m" for c in EMB))
def _(spark, sf):
    return checks.constant_column_guard(fx.embedding_matrix(spark, sf), EMB)


@query("finite_guard", f"""WITH {BARS}, r AS (SELECT ln(AdjClose) - {lag('ln(AdjClose)')} AS Return_1d, {roll('avg', 'AdjClose', 50)} AS SMA_50 FROM fx_bars)
 SELECT 'Return_1d' AS "Column", count(*) - count(Return_1d) AS Bad FROM r UNION ALL SELECT 'SMA_50', count(*) - count(SMA_50) FROM r""")
def _(spark, sf):
    return checks.finite_guard(features.series_features(fx.bars(spark, sf), only=["log_returns", "sma"]), ["Return_1d", "SMA_50"])


@query("key_uniqueness", f"WITH {RAW} SELECT Date, Ticker, count(*) AS Copies FROM fx_raw GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return checks.duplicate_keys(fx.raw_with_repeats(spark, sf))


def _consistency_sql(src: str) -> str:
    return f"""SELECT '{src}' AS Panel, min_sessions, max_sessions, min_series, max_series, min_sessions = max_sessions AND min_series = max_series AS consistent
 FROM (SELECT min(c) AS min_sessions, max(c) AS max_sessions FROM (SELECT count(*) AS c FROM {src} GROUP BY Ticker)),
  (SELECT min(c) AS min_series, max(c) AS max_series FROM (SELECT count(*) AS c FROM {src} GROUP BY Date))"""


@query("calendar_consistency", f"{SPARSE_ALIGNED} {_consistency_sql('aligned')} UNION ALL {_consistency_sql('fx_sparse')}")
def _(spark, sf):
    """The panel before and after alignment."""
    raw = fx.sparse_bars(spark, sf)
    panels = {"aligned": cleaning.align_calendar(raw, CALENDAR), "fx_sparse": raw}
    return reduce(DataFrame.unionByName, [checks.calendar_consistency(p).withColumn("Panel", F.lit(name)) for name, p in panels.items()])


@query("intersect_keys", f"WITH {BARS}, {SPARSE} SELECT Date FROM fx_bars INTERSECT SELECT Date FROM fx_sparse")
def _(spark, sf):
    return checks.key_intersection(fx.bars(spark, sf).select(TIME), fx.sparse_bars(spark, sf).select(TIME))


@query("except_keys", f"""WITH {BARS}, {SPARSE}, a AS (SELECT DISTINCT Date FROM fx_bars), b AS (SELECT DISTINCT Date FROM fx_sparse)
 SELECT Date, 'missing' AS Side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT Date, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(spark, sf):
    return checks.key_difference(fx.bars(spark, sf).select(TIME), fx.sparse_bars(spark, sf).select(TIME))


SPLIT_SQL = f"""WITH {BARS}, d AS (SELECT DISTINCT Date FROM fx_bars), o AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS i, count(*) OVER () AS n FROM d),
 sp AS (SELECT Date, CASE WHEN i < floor(n * 7e-1) THEN 'train' WHEN i < floor(n * 7e-1) + floor(n * 15e-2) THEN 'val' ELSE 'test' END AS Split FROM o)"""


@query("date_split", SPLIT_SQL + " SELECT Date, Split FROM sp")
def _(spark, sf):
    return labels.date_split(fx.bars(spark, sf))


@query("split_summary", SPLIT_SQL + """ SELECT Split, count(*) AS n_rows, count(DISTINCT b.Date) AS sessions, min(b.Date) AS first_date, max(b.Date) AS last_date
 FROM fx_bars b JOIN sp ON sp.Date = b.Date GROUP BY Split""")
def _(spark, sf):
    return labels.split_summary(labels.with_split(fx.bars(spark, sf))).withColumnRenamed("rows", "n_rows")


@query("disjoint_splits", SPLIT_SQL + """, r AS (SELECT b.Date, CASE WHEN day(b.Date) = 1 AND Ticker = 'AF' THEN 'test' ELSE Split END AS Split FROM fx_bars b JOIN sp ON sp.Date = b.Date)
 SELECT Date, count(DISTINCT Split) AS splits FROM r GROUP BY Date HAVING count(DISTINCT Split) > 1""")
def _(spark, sf):
    """One series is put into the test rows on the first of each month; these dates overlap."""
    rows = labels.with_split(fx.bars(spark, sf))
    wrong = (F.dayofmonth("Date") == 1) & (F.col("Ticker") == "AF")
    return labels.splits_overlap(rows.withColumn("Split", F.when(wrong, "test").otherwise(F.col("Split"))))


@query("partition_semi", SPLIT_SQL + f" SELECT b.Date, Ticker, {g('Close')} AS Close FROM fx_bars b WHERE b.Date IN (SELECT Date FROM sp WHERE Split = 'test')")
def _(spark, sf):
    bars = fx.bars(spark, sf)
    test = labels.date_split(bars).where("Split = 'test'")
    return publish(bars.join(F.broadcast(test), "Date", "left_semi"), KEYS, ["Close"])


@query("sort_panel", f"WITH {BARS} SELECT Date, Ticker, {g('Close')} AS Close FROM fx_bars ORDER BY Ticker, Date")
def _(spark, sf):
    return publish(fx.bars(spark, sf).orderBy("Ticker", "Date"), KEYS, ["Close"])


@query("tail_n", f"WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS rn FROM fx_bars) SELECT Date, Ticker, {g('Close')} AS Close FROM k WHERE rn <= 120")
def _(spark, sf):
    return publish(signals.tail_n(fx.bars(spark, sf), 120), KEYS, ["Close"])


@query("latest_per_key", f"WITH {WIDE_BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS rn FROM fx_wide) SELECT Date, Ticker, {gcols(FIELDS)} FROM k WHERE rn = 1")
def _(spark, sf):
    return publish(signals.latest_per_key(fx.wide_bars(spark, sf)), KEYS, FIELDS)


@query("first_last_return", f"""WITH {BARS}, w AS (SELECT * FROM fx_bars WHERE Date >= (SELECT max(Date) FROM fx_bars) - 365)
 SELECT Ticker, {g('arg_min(AdjClose, Date)')} AS first_price, {g('arg_max(AdjClose, Date)')} AS last_price,
 {g('arg_max(AdjClose, Date) / arg_min(AdjClose, Date) - 1')} AS window_return FROM w GROUP BY Ticker""")
def _(spark, sf):
    return publish(signals.first_last_return(recent_rows(fx.bars(spark, sf), 365)), ["Ticker"], ["first_price", "last_price", "window_return"])


