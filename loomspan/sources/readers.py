"""Readers and schema checks for price panels, context series, CSV/JSON artifacts and news files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.expr import finite

PRICE_FIELDS = ("Open", "High", "Low", "Close", "AdjClose", "Volume")
PANEL_COLUMNS = ("Date", "Ticker", *PRICE_FIELDS)

PANEL_SCHEMA = T.StructType(
    [T.StructField("Date", T.DateType()), T.StructField("Ticker", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_FIELDS]
)

NEWS_CHUNK_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("articles", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("seendate", T.StringType()),
    ]))),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores (one small file) is dealt out before row-wise heavy work; a larger one is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {df.columns}")
    return df


def scan_panel(raw: DataFrame) -> DataFrame:
    """Price panel contract: session dates without time or zone, doubles, NaN and inf as NULL."""
    require_columns(raw, PANEL_COLUMNS)
    return raw.select(
        F.to_date("Date").alias("Date"),
        F.col("Ticker").cast("string").alias("Ticker"),
        *[finite(F.col(c).cast("double")).alias(c) for c in PRICE_FIELDS],
    )


def unpivot_ohlcv(wide: DataFrame, sep: str = "|") -> DataFrame:
    """Wide vendor result ("<Field>|<Ticker>" columns) to the long contract, rows without any value dropped.

    One pass: the columns of each ticker become one struct of an array that is exploded, so no
    regrouping by (Date, Ticker) is needed.
    """
    rename = {"Adj Close": "AdjClose", "Adjusted Close": "AdjClose"}
    found: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        if sep in c:
            fieldname, ticker = c.split(sep, 1)
            found.setdefault(ticker, {})[rename.get(fieldname, fieldname)] = c
    if not found:
        raise ValueError("no '<Field>|<Ticker>' columns found")
    for ticker, cols in found.items():
        missing = [f for f in PRICE_FIELDS if f not in cols]
        if missing:
            raise ValueError(f"series {ticker} lacks required fields {missing}")
    rows = F.array(*[
        F.struct(F.lit(t).alias("Ticker"), *[F.col(f"`{cols[f]}`").cast("double").alias(f) for f in PRICE_FIELDS])
        for t, cols in sorted(found.items())
    ])
    return (
        wide.select("Date", F.explode(rows).alias("r")).select("Date", "r.*")
        .where(F.coalesce(*[F.col(c) for c in PRICE_FIELDS]).isNotNull())
    )


def scan_macro(wide: DataFrame) -> DataFrame:
    """Wide low-frequency table (Date + one column per series) to long (Date, Series, Value)."""
    series = [c for c in wide.columns if c != "Date"]
    return (
        wide.select(F.to_date("Date").alias("Date"), *[F.col(c).cast("double") for c in series])
        .unpivot("Date", series, "Series", "Value")
        .where(F.col("Value").isNotNull())
    )


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, key: str = "key") -> DataFrame:
    """CSV with header; an unnamed first column is the key column and is given a name."""
    df = spark.read.csv(path, header=True, schema=schema)
    first = df.columns[0]
    return df.withColumnRenamed(first, key) if first in ("", "_c0") or first.startswith("Unnamed") else df


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def normalise_date(df: DataFrame, name: str = "Date") -> DataFrame:
    """Guarantee a real Date column: the one named Date, else the first date or timestamp column."""
    if name not in df.columns:
        timed = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
        if not timed:
            raise KeyError(f"no {name} column and no date-typed column in {df.columns}")
        df = df.withColumnRenamed(timed[0], name)
    return df.withColumn(name, F.to_date(name))


def read_news_chunks(spark: SparkSession, path: str) -> DataFrame:
    return shape_news_chunks(spark.read.schema(NEWS_CHUNK_SCHEMA).json(path))


def shape_news_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows {ticker, start, end, articles[]} to article rows; works on batch and stream input.

    Titles are trimmed, empty titles and unparseable dates dropped.
    """
    return (
        chunks.select(F.col("ticker").alias("Ticker"), F.explode("articles").alias("a"))
        .select(
            "Ticker",
            F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("Timestamp"),
            F.trim("a.title").alias("Headline"),
            F.lit("").alias("Summary"),
            F.coalesce(F.nullif(F.col("a.url"), F.lit("")), F.trim("a.title")).alias("ArticleKey"),
        )
        .where((F.length("Headline") > 0) & F.col("Timestamp").isNotNull())
    )


def shape_epoch_news(raw: DataFrame) -> DataFrame:
    """Provider rows with epoch seconds; rows with neither headline nor summary are dropped."""
    headline = F.trim(F.coalesce("headline", F.lit("")))
    summary = F.trim(F.coalesce("summary", F.lit("")))
    return raw.select(
        F.col("ticker").alias("Ticker"),
        F.timestamp_seconds("datetime").alias("Timestamp"),
        headline.alias("Headline"),
        summary.alias("Summary"),
    ).where((F.length("Headline") > 0) | (F.length("Summary") > 0))


def distinct_articles(news: DataFrame) -> DataFrame:
    """Repeats by (ticker, url-or-title), then by (ticker, time, headline).

    The earliest article of a key stays. Both steps are aggregates with a map-side part, so a hot
    key with very many copies collapses before the shuffle.
    """
    cols = news.columns
    best = news.groupBy("Ticker", "ArticleKey").agg(
        F.min_by(F.struct(*cols), F.struct("Timestamp", "Headline")).alias("a"))
    first = best.select("a.*")
    return first.groupBy("Ticker", "Timestamp", "Headline").agg(
        *[F.min(c).alias(c) for c in cols if c not in ("Ticker", "Timestamp", "Headline")]
    )


def date_chunks(start: str, end: str, days: int, spark: SparkSession) -> DataFrame:
    """Fetch plan: consecutive [start, stop] spans of at most `days` civil days."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return date_spans(spark.range(1).select(lo.alias("lo"), hi.alias("hi")), days)


def date_spans(bounds: DataFrame, days: int) -> DataFrame:
    step = F.expr(f"interval {int(days)} days")
    return (
        bounds.select("hi", F.explode(F.sequence("lo", "hi", step)).alias("Start"))
        .select("Start", F.least(F.date_add("Start", days - 1), F.col("hi")).alias("Stop"))
    )
