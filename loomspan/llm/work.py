"""Written intermediates of one operator run, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.session import run_dir


class Work:
    """Tables written to cut lineage; every run has a folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, run_dir(spark, label)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and gives it back as read from the shared folder."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
