"""Panels, context series, news and predictions derived from the star-schema tables.

Prices are built with min_by/max_by aggregates: they have a map-side part, so a (date, series)
group of any size collapses before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.config import EngineConfig, PortfolioConfig
from loomspan.functions.expr import by_series
from loomspan.functions.text import tokens
from loomspan.sources.readers import spread, table

BARS_CONFIG = EngineConfig(universe=("AF", "AO", "NF", "RF"), benchmark="NO", volatility_index="RO",
                           portfolio=PortfolioConfig(cap=0.4))
SPARSE_CONFIG = EngineConfig(
    universe=("1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"), benchmark="3-MEDIUM")

# Test lexicon of frequent document tokens with valences.
LEXICON = (
    ("the", 0.4), ("and", 0.9), ("that", -0.7), ("with", 1.3), ("for", 0.6), ("was", -1.1),
    ("le", 0.5), ("les", -0.8), ("des", 1.2), ("pour", 1.7), ("und", 0.8), ("der", -0.6),
    ("die", -1.9), ("das", 1.1), ("que", -0.4), ("los", 0.7), ("las", -1.3), ("por", 1.5),
    ("never", -1.0), ("good", 1.9), ("bad", -2.5),
)
# Test rules of the lexicon automaton.
RULES = tuple([(t, "negation", -0.74) for t in ("not", "no", "never", "nicht", "pas", "non")]
              + [(t, "booster", 0.293) for t in ("more", "very", "as", "zu", "par")]
              + [(t, "booster", -0.293) for t in ("at", "auf", "sur")]
              + [(t, "contrast", 1.5) for t in ("but", "aber", "mais", "pero", "than")])
# Portfolio weights used by the weight operators.
TARGET_WEIGHTS = (("AF", 0.4), ("AO", 0.3), ("NF", 0.2), ("RF", 0.1))


def _lineitem_bars(spark: SparkSession, sf_dir: str, ticker) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    px = F.col("l_extendedprice") / 1000.0
    close = F.max(order)["l_extendedprice"] / 1000.0  # the price is in the order already: no second copy in the shuffle
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("Date"), ticker.alias("Ticker"))
        .agg(
            (F.min(order)["l_extendedprice"] / 1000.0).alias("Open"),
            F.max(px).alias("High"),
            F.min(px).alias("Low"),
            close.alias("Close"),
            (close * (1 - F.avg("l_discount"))).alias("AdjClose"),
            F.sum("l_quantity").alias("Volume"),
        )
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense panel: six series named by return flag and line status."""
    return _lineitem_bars(spark, sf_dir, F.concat("l_returnflag", "l_linestatus"))


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with one series per supplier; the number of series grows with the data."""
    return _lineitem_bars(spark, sf_dir, F.col("l_suppkey").cast("string"))


def sparse_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with natural gaps: one series per order priority."""
    px = F.col("o_totalprice") / 1000.0
    close = F.max_by(px, F.col("o_orderkey"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("Date"), F.col("o_orderpriority").alias("Ticker"))
        .agg(
            F.min_by(px, F.col("o_orderkey")).alias("Open"),
            F.max(px).alias("High"), F.min(px).alias("Low"),
            close.alias("Close"), close.alias("AdjClose"),
            F.count("*").cast("double").alias("Volume"),
        )
    )


def raw_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sparse_bars plus disagreeing copies (no adjusted close, Close + 1) of the first day of each month."""
    base = sparse_bars(spark, sf_dir)
    copies = base.where(F.dayofmonth("Date") == 1).withColumns(
        {"AdjClose": F.lit(None).cast("double"), "Close": F.col("Close") + 1})
    return base.unionByName(copies)


def bad_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars whose Low exceeds High on the 13th of each month."""
    return bars(spark, sf_dir).withColumn(
        "Low", F.when(F.dayofmonth("Date") == 13, F.col("High") + 1).otherwise(F.col("Low")))


def calm_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars with daily moves damped to a few percent, for return compounding and portfolio scores."""
    return bars(spark, sf_dir).withColumn("AdjClose", 100.0 * F.pow("AdjClose", F.lit(0.02)))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-frequency series, long: one release per month and order status."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("Date"),
                 F.col("o_orderstatus").alias("Series"))
        .agg((F.avg("o_totalprice") / 1000.0).alias("Value"))
    )


MARKET = "MARKET"


def with_market(panel: DataFrame) -> DataFrame:
    """The panel and a series that trades on every day on which any series does: mean prices, all volume."""
    prices = ("Open", "High", "Low", "Close", "AdjClose")
    market = panel.groupBy("Date").agg(*[F.avg(c).alias(c) for c in prices], F.sum("Volume").alias("Volume"))
    return panel.unionByName(market.withColumn("Ticker", F.lit(MARKET)))


def news_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session days for the news: event days without weekends."""
    return (
        table(spark, sf_dir, "events").select(F.to_date("ts").alias("Date"))
        .where(F.weekday("Date") < 5).distinct()
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: each document is published at the time and under the type of one event, all over the events' span.

    Document d takes event d * 7919 modulo the number of events, another one for each as long as there are more events.
    Headline is the text up to the first period or line end, Summary the whole rest.
    """
    head = F.regexp_extract("text", "^[^.\\n]*", 0)
    events = table(spark, sf_dir, "events")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return (
        docs.withColumn("_number", F.col("doc_id") * 7919 % events.agg(F.count("*")).scalar())
        .join(events.select("event_id", "ts", "event_type"), F.col("_number") == F.col("event_id"))
        .select(
            F.col("doc_id").alias("ArticleId"), F.col("event_type").alias("Ticker"),
            F.col("ts").alias("Timestamp"), head.alias("Headline"),
            F.expr("substring(text, length(regexp_extract(text, '^[^.\\\\n]*', 0)) + 2)").alias("Summary"),
            F.col("n_chars"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_over(bars(spark, sf_dir))


def calm_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_over(calm_bars(spark, sf_dir))


def predictions_over(panel: DataFrame, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Three forecast models over the daily log returns of a panel, with the next return as outcome.

    Columns to keep follow the others. `whole` also keeps the rows without a forecast or an outcome, with NULLs.
    """
    lp = F.ln("AdjClose")
    r = panel.select("Date", "Ticker", "AdjClose", *keep, (lp - F.lag(lp).over(by_series())).alias("r"),
                     (F.lead(lp).over(by_series()) - lp).alias("Actual_Return"))
    if not whole:
        r = r.where(F.col("r").isNotNull() & F.col("Actual_Return").isNotNull())
    models = F.array(*[
        F.struct(F.lit(m).alias("Model"), (F.col("r") * c).alias("Predicted_Return"))
        for m, c in (("mom", 0.1), ("rev", -0.1), ("zero", 0.0))
    ])
    return r.select("Date", "Ticker", "AdjClose", "Actual_Return", *keep, F.explode(models).alias("m")).select(
        "Date", "Ticker", "AdjClose", "Actual_Return", "m.Model", "m.Predicted_Return", *keep)


def bar_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bar_sentiment_of all bar series."""
    return bar_sentiment_of(bars(spark, sf_dir))


def bar_sentiment_of(panel: DataFrame) -> DataFrame:
    """Daily score of each series: where the close sits between open and range, in [-1, 1]."""
    span = F.nullif(F.col("High") - F.col("Low"), F.lit(0.0))
    return panel.select(
        "Date", "Ticker", F.coalesce((F.col("Close") - F.col("Open")) / span, F.lit(0.0)).alias("Sentiment_FinBERT"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel of the event stream: one series per event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("Date"), F.col("event_type").alias("Ticker"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("Close"), F.count("*").alias("Volume"))
    )


def labelled_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news with a classifier label (from labels, where known) and a confidence that grows with the length."""
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("ArticleId"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("Label"))
    return news(spark, sf_dir).join(marks, "ArticleId", "left").withColumn(
        "Confidence", F.col("n_chars") / (F.col("n_chars") + 500.0))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "token string, valence double")


def learned_lexicon(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Valences from labelled documents: twice the log odds of good against toxic documents for every token in at least three of them.

    Only texts with a label are taken apart.
    """
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    known = table(spark, sf_dir, "documents").select("doc_id", "text").join(marks.select("doc_id"), "doc_id", "left_semi")
    seen = known.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    counts = seen.distinct().join(marks, "doc_id").groupBy("token").agg(
        F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"))
    return counts.where(F.col("n") >= least).select("token", (2.0 * F.ln((F.col("good") + 1.0) / (F.col("bad") + 1.0))).alias("valence"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "token string, kind string, weight double")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, w, 0.25) for a, w in TARGET_WEIGHTS],
                                 "Ticker string, Target_Weight double, Current_Weight double")


def embedding_matrix(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """embeddings as numeric columns e0..e63, plus an exact affine copy of e0 and the label as Target."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)],
        (2 * F.col("embedding")[0].cast("double") + 5).alias("z_copy"),
        F.col("label").cast("double").alias("Target"),
    )


