"""Session helpers: work folder for checkpoints and written intermediates, and a local test session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_RUN_DIRS: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster in spark.checkpoint.dir; a temp folder only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomspan-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder for one run, forgotten by drop_run_dirs."""
    _RUN_DIRS.append(os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex}"))
    return _RUN_DIRS[-1]


def drop_run_dirs(spark: SparkSession) -> int:
    """Deletes the run folders made in this session, in whatever store they are; call it when no result is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for made in _RUN_DIRS:
        path = jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(conf).delete(path, True)
    count = len(_RUN_DIRS)
    _RUN_DIRS.clear()
    return count


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back: survives the loss of executors.

    `lean` spares disk: the files are packed more tightly, and the shuffle files behind them go with the end of the write instead
    of with the driver's next collection of garbage.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    if lean:
        _write_lean(df, path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _write_lean(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspan")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
