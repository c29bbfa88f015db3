"""Session, table and lineage helpers shared by every operator.

Executors import this package, so on a cluster ship it with ``--py-files``
(or put the repository on ``PYTHONPATH``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("missive")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder; NTZ timestamps become UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def balanced(df: DataFrame) -> DataFrame:
    """``df`` spread over all cores if it comes in far fewer partitions, as a table of one small file does.

    For work that costs much more a row than moving the row; a large table comes in many partitions and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder that ``spark.checkpoint.dir`` names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, by ``spark.checkpoint.dir``.

    Only a session on this machine alone may do without it, and gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return os.path.join(tempfile.gettempdir(), "missive-checkpoints")


def spread(df: DataFrame, salts: int, *columns: str) -> DataFrame:
    """``df`` with a ``salt`` column in [0, salts) taken from a hash of ``columns``."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
