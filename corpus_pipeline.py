"""Corpus pipeline: language identification, near-dedup, redaction, mixing, encoding, one after the other.

Each stage takes (spark, docs, sf_dir) with the columns of documents and works on all rows its predecessor kept; between stages
the rows are written as Parquet and read again, so every stage is planned on its own and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import language, mixing, odd_sketch, pieces, pii
from loomspan.llm.work import Work
from loomspan.plans.registry import Query


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go."""
    return language.accepted(docs, language.fit(docs))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return odd_sketch.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in brackets; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the rate of its source says; documents with no copy go."""
    return mixing.mix(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("language", known_language),
    ("near_dedup", one_per_group),
    ("redact", without_personal_data),
    ("mix", mixed_sources),
    ("encode", as_pieces),
]

#: SQL can express neither the classifier nor the encoder; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of a table folder."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = Query(run, ORACLE_SQL)
