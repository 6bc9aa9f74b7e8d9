"""Session factory and the one place that decides where lineage is cut."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Seconds of a write after which its shuffle files are worth a collection of the driver's garbage.
LONG_WRITE = 4.0


def build_session(app: str = "lithic", cpus: str | None = None) -> SparkSession:
    """Local session for tests, the bench and the command line; a cluster brings its own."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a local one only when unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lithic-checkpoint-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from that table.

    The rows are computed once, survive the loss of any executor, and come back with file statistics,
    so later joins know how large they are. A session's tables share one sub-folder, named after the
    application, that can be dropped when the job is over.
    """
    return cut_counted(df)[0]


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut` plus the number of rows, counted while they are written."""
    out, seen = cut_observed(df)
    return out, seen["n"]


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """`cut` plus aggregates gathered in the same pass; `n` is always the number of rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/lithic-{sc.applicationId}/{uuid.uuid4().hex}"
    seen = Observation()
    extra = [m.alias(name) for name, m in metrics.items()]
    began = time.monotonic()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *extra).write.parquet(path)
    found = dict(seen.get)
    if time.monotonic() - began > LONG_WRITE:
        release(spark)
    return spark.read.schema(df.schema).parquet(path), found


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished writes.

    Spark deletes them once the driver has collected the plans that they belong to, which a large heap puts off until the disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly row-wise work on a small input.

    A handful of input splits would leave most cores idle, so such inputs are dealt out evenly.
    Inputs that already have enough splits, which is every large one, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
