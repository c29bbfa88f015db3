"""Sinks: record files with an index, line exports and an upsert by log and fold.

Parquet has no MERGE, so an upsert appends to a log, and the current state is
an aggregate of the log; nothing is rewritten in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_name(key: Column) -> Column:
    """A file name of a key: letters, digits, ``_`` and ``-``, at most 80."""
    return F.substring(F.regexp_replace(key, r"[^A-Za-z0-9_-]", "_"), 1, 80)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line."""
    rows.write.mode("overwrite").json(path)


def write_records(rows: DataFrame, key: str, path: str) -> None:
    """JSON rows in one folder per record, and an index of names beside them."""
    named = rows.withColumn("record", safe_name(F.col(key)))
    named.write.mode("overwrite").partitionBy("record").json(f"{path}/records")
    named.select("record", key).write.mode("overwrite").json(f"{path}/index")


def append_reports(reports: DataFrame, log: str) -> None:
    """Add reports (key, note, source, payload, reported_at) to the log."""
    reports.write.mode("append").parquet(log)


def fold_reports(log: DataFrame, key: str) -> DataFrame:
    """One row per key: report_count, notes in order, sources, last payload, first and last time."""
    notes = F.sort_array(F.collect_list(F.when(F.coalesce("note", F.lit("")) != "", F.struct("reported_at", "note"))))
    return log.groupBy(key).agg(
        F.count("*").alias("report_count"),
        F.array_join(F.array_distinct(F.transform(notes, lambda n: n["note"])), "\n").alias("notes"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.max_by("payload", "reported_at").alias("payload"),
        F.min("reported_at").alias("first_reported_at"),
        F.max("reported_at").alias("last_reported_at"),
    )


def newest(rows: DataFrame, time: str, key: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows: a retention filter."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(keep)


def overwrite_without(rows: DataFrame, gone: DataFrame, key: str, path: str) -> None:
    """Write ``rows`` without those whose key is in ``gone``."""
    rows.join(gone.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(path)
