"""Session and small helpers that every operator shares."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "paperlode", cores: int | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own session."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(max(8, cores)))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that lost executors cost no rework.

    The folder is the one that the session names in spark.checkpoint.dir; one of our own is set only where the setting
    is absent and all tasks run in this process, as in tests. On a cluster its absence is an error. Files of the
    checkpoint go when nothing refers to it any longer, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the shuffles and checkpoints that nothing refers to any longer go now: Spark's cleaner finds them only when the
    driver collects its garbage, which a driver with memory to spare seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Give a Python stage work for every core when the scan has too few splits (one small file).

    With at least as many splits as cores, which is the rule on large tables, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
