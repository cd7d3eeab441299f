"""Incremental forms: news ingest, session sentiment and bars from ticks. Each returns a streaming DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.sentiment import map_to_session
from loomspan.session import run_dir
from loomspan.sources.readers import NEWS_CHUNK_SCHEMA, shape_news_chunks


def stream_news_ingest(spark: SparkSession, path: str, delay: str = "30 days", per_trigger: int = 100) -> DataFrame:
    """Articles from arriving chunk files, without repeats within the watermark.

    A repeat has the ticker and the url-or-title of an earlier article, or its ticker, time and headline.
    """
    chunks = (
        spark.readStream.schema(NEWS_CHUNK_SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)
    )
    seen = shape_news_chunks(chunks).withWatermark("Timestamp", delay)
    return seen.dropDuplicatesWithinWatermark(["Ticker", "ArticleKey"]).dropDuplicatesWithinWatermark(["Ticker", "Timestamp", "Headline"])


def stream_session_sentiment(articles: DataFrame, calendar: DataFrame, close_hour: int = 16,
                             delay: str = "3 days") -> DataFrame:
    """Mean score and article count per (session, ticker) of a stream of scored articles.

    The session is the event time; articles behind the watermark are dropped. Appended output has a (session, ticker)
    once the watermark has passed it, updates (see drain_updates) have the open ones too. The calendar is static, small and must reach beyond the stream.
    """
    placed = map_to_session(articles, calendar, close_hour)
    return (
        placed.withColumn("Session", F.col("Date").cast("timestamp"))
        .withWatermark("Session", delay)
        .groupBy("Session", "Ticker")
        .agg(F.avg("Score").alias("Sentiment"), F.count("*").alias("News_Volume"))
        .select(F.to_date("Session").alias("Date"), "Ticker", "Sentiment", "News_Volume")
    )


def stream_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and volume per tumbling window and series of ticks (ts, id, Ticker, price).

    All five are aggregates with a map-side part; state is one row per open (window, series).
    """
    order = F.struct("ts", "id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "Ticker")
        .agg(F.min_by("price", order).alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"),
             F.max_by("price", order).alias("Close"), F.count("*").alias("Volume"))
        .select(F.col("window.start").alias("Start"), "Ticker", "Open", "High", "Low", "Close", "Volume")
    )


def read_file_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = 100) -> DataFrame:
    """Files in the order of their arrival, so many in a micro-batch, or all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(path)


def drain(stream: DataFrame, label: str, arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Run a stream over everything available into the shared work folder and return the written rows.

    Arrivals write files one after the other; after each the stream is started anew and goes on from its checkpoint.
    """
    spark = stream.sparkSession
    base = run_dir(spark, label)
    out, mark = os.path.join(base, "rows"), os.path.join(base, "checkpoint")
    for arrive in arrivals or (lambda: None,):
        arrive()
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", mark).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, label: str, keys: list[str], arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Run an aggregating stream over everything available and return the latest row of each key.

    Groups that the watermark has not closed yet are included. Every micro-batch writes its updates to a folder of its own,
    which a repeated batch overwrites. Arrivals write files one after the other; after each the stream goes on from its checkpoint
    over all files that are there, so that any number of files written at once are one step of the event time.
    """
    spark = stream.sparkSession
    base = run_dir(spark, label)
    out, mark = os.path.join(base, "rows"), os.path.join(base, "checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    for arrive in arrivals or (lambda: None,):
        arrive()
        query = (
            stream.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", mark).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    updates = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_latest"))
    return latest.select(*keys, *[F.col("_latest")[c].alias(c) for c in values]).select(*stream.columns)
