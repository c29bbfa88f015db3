"""Windowed breakdowns, rollups, facets and incremental-ingest windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """label, n for every label in order, then labels not foreseen; zero where absent."""
    known = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], "position int, label string")
    counted = rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return (
        counted.join(known, "label", "full").select(
            "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("position", F.lit(len(labels))).alias("position")
        )
    )


def counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows per condition, in one pass."""
    return rows.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def metrics(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Aggregates of one pass over the rows as rows of (metric, n)."""
    one = rows.agg(*(a.cast("bigint").alias(n) for n, a in aggregates.items()))
    return one.unpivot([], list(aggregates), "metric", "n")


def rollup(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both columns, by each alone and in total; the total of nothing is 0."""
    both = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    # The pre-aggregate is what gets expanded, not the rows.
    parts = both.groupingSets([[F.col(a), F.col(b)], [F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(
        F.sum("n").alias("n"), F.grouping_id().cast("bigint").alias("level")
    )
    none = F.lit(None).cast("string")
    total = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(none.alias(a), none.alias(b), "n", F.lit(3).cast("bigint").alias("level"))
    return parts.unionByName(total)


def day_runs(rows: DataFrame, time: str, zone: str) -> DataFrame:
    """Consecutive runs of rows on one local day, rows in order of time: run, day, n.

    Numbered by a window over the days that occur, which are few, not over rows.
    """
    day = F.to_date(F.from_utc_timestamp(F.col(time), zone))
    per_day = rows.groupBy(day.alias("d")).agg(F.count("*").alias("n"))
    return per_day.select(
        F.row_number().over(Window.orderBy("d")).cast("bigint").alias("run"), F.date_format("d", "EEEE, MMM dd").alias("day"), "n"
    )


def run_groups(listed: DataFrame, label: Column, order: list[Column]) -> DataFrame:
    """``listed`` with ``run``: a list in its order, cut wherever the label changes; a label may come back in a later run.

    Numbers the whole list in one place, so it is for lists that a limit bounds.
    """
    w = Window.orderBy(*order)
    marked = listed.withColumn("_label", label)
    new = F.coalesce((~F.col("_label").eqNullSafe(F.lag("_label").over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    marked = marked.withColumn("_new", F.when(first, 1).otherwise(new))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_label", "_new")


def origin_windows(rows: DataFrame, time: str, seconds: int, origin: Column) -> DataFrame:
    """Closed-open windows counted from an origin: window_start, window_end (epoch seconds), n.  Earlier rows are left out."""
    at = F.unix_seconds(F.col(time))
    start = origin + F.floor((at - origin) / seconds) * seconds
    return (
        rows.where(at >= origin).groupBy(start.cast("bigint").alias("window_start")).agg(F.count("*").alias("n"))
        .select("window_start", (F.col("window_start") + seconds).alias("window_end"), "n")
    )


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in any column, case aside; ``%`` and ``_`` of the needle are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).like(f"%{needle.lower()}%")
    return rows.where(hit)


def purge_plan(parents: DataFrame, children: dict[str, tuple[DataFrame, str, str]], in_window: Column, parent_key: str) -> DataFrame:
    """How many rows a window purge would remove: table, n.

    A child goes if it lies in the window itself or its parent does; rows, not
    matches, are counted.  ``children``: name -> (rows, parent column, time column).
    """
    gone = parents.where(in_window).select(F.col(parent_key).alias("_gone")).distinct()
    out = gone.agg(F.count("*").alias("n")).select(F.lit("parent").alias("table"), "n")
    for name, (rows, key, flag) in children.items():
        joined = rows.select(F.col(key).alias("_gone"), F.col(flag).alias("_own")).join(
            gone.withColumn("_hit", F.lit(True)), "_gone", "left"
        )
        n = joined.where(F.col("_own") | F.col("_hit").isNotNull()).agg(F.count("*").alias("n"))
        out = out.unionByName(n.select(F.lit(name).alias("table"), "n"))
    return out
