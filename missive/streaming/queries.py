"""Streams over the event files, run to the end of the data (``availableNow``)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.runtime import shared_folder
from missive.streaming import pipeline

Query = Callable[[SparkSession, str], DataFrame]


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a file stream."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    return stream.parquet(path) if os.path.isdir(path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; their time becomes a watermarkable instant."""
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    counted = pipeline.window_counts(_events(spark, d), "ts", "event_type", "1 hour", "10 minutes")
    return pipeline.drain(counted, _folder(spark), "complete").select("window_start_s", "event_type", "n")


def _fold(spark: SparkSession, d: str) -> DataFrame:
    folded = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most"))
    return pipeline.drain(folded, _folder(spark), "complete")


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    doubled = _events(spark, d)
    doubled = doubled.unionByName(_events(spark, d))
    return pipeline.drain(pipeline.deduplicated(doubled, "event_id", "ts", "5 minutes").select("event_id", "user_id"), _folder(spark), "append")


def _status(spark: SparkSession, d: str) -> DataFrame:
    """Statuses folded over the event stream: the highest rank wins, the earliest event of it; repeated rows change nothing."""
    from missive.operators.fold import rank_of
    from missive.plans.registry import CLOSED, RANKS

    order = F.struct(rank_of(F.col("kind"), RANKS).alias("rank"), (-F.unix_micros("occurred_at")).alias("age"), (-F.col("id")).alias("id"))
    events = _stream(spark, d, "application_event").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    folded = events.groupBy("application_id").agg(F.max_by("kind", order).alias("status"))
    return pipeline.drain(folded, _folder(spark), "complete").withColumn("closed", F.col("status").isin(*sorted(CLOSED)))


def queries() -> dict[str, Query]:
    return {"stream_windows": _windows, "stream_fold": _fold, "stream_dedup": _dedup, "stream_status": _status}


def oracle_sql() -> dict[str, str]:
    from missive.plans.registry import _CLOSED_SQL, _RANK_SQL

    return {
        "stream_status": f"""SELECT application_id, kind AS status, kind IN ({_CLOSED_SQL}) AS closed FROM (SELECT application_id, kind,
        row_number() OVER (PARTITION BY application_id ORDER BY {_RANK_SQL} DESC, occurred_at, id) AS r FROM (SELECT DISTINCT id, application_id, kind, occurred_at FROM application_event)) WHERE r = 1""",
        "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS bigint) AS window_start_s, event_type, CAST(count(*) AS bigint) AS n FROM events GROUP BY 1, 2",
        "stream_fold": "SELECT user_id, CAST(count(*) AS bigint) AS n, round(max(value), 6) AS most FROM events GROUP BY user_id",
        "stream_dedup": "SELECT event_id, user_id FROM events",
    }
