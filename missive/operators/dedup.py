"""Duplicate search and survivorship across records.

All are windows or aggregates on a key.  A key that holds a large share of all
rows stays cheap: roots and best rows are map-side combined aggregates joined
back, not windows, wherever one row per key suffices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_root(rows: DataFrame, key: Column, order: list[str], root: str = "root_id", id_column: str = "id") -> DataFrame:
    """Each row with the id of its key's first row in ``order``; rows without key are their own root.

    The first row per key is an aggregate; only keys of two or more are joined
    back, and those with a hot key are split by the adaptive skew join.
    """
    keyed = rows.withColumn("_key", F.when(key != "", key))
    first = (
        keyed.where(F.col("_key").isNotNull()).groupBy("_key")
        .agg(F.min_by(id_column, F.struct(*order)).alias(root), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    return keyed.join(first, "_key", "left").withColumn(root, F.coalesce(root, F.col(id_column))).drop("_key")


def best_per_key(rows: DataFrame, keys: list[str], preference: list[Column]) -> DataFrame:
    """The one row of each key that comes first by ``preference`` (ascending)."""
    packed = F.struct(*rows.columns)
    order = F.struct(*(p.alias(f"o{i}") for i, p in enumerate(preference)))
    best = rows.groupBy(*keys).agg(F.min_by(packed, order).alias("r"))
    return best.select("r.*")


def pointers(rows: DataFrame, key: str, order: list[str], id_column: str = "id") -> DataFrame:
    """Later occurrences of a key as pointers: id, key, root_id, seq (0 for the first).

    ``order`` begins with an instant.  Places are counted within a key's days and
    shifted by the counts of the days before, so a hot key is split by days.
    """
    dated = rows.select(id_column, key, *(c for c in order if c not in (id_column, key)), F.to_date(order[0]).alias("_day"))
    days = dated.groupBy(key, "_day").agg(F.count("*").alias("_n"))
    before = days.select(
        key, F.col("_day").alias("_of"),
        F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    first = dated.groupBy(key).agg(F.min_by(id_column, F.struct(*order)).alias("root_id")).withColumnRenamed(key, "_key")
    place = F.row_number().over(Window.partitionBy(key, "_day").orderBy(*order)) - 1
    counted = dated.withColumn("_place", place).join(before, [key]).where(F.col("_day").eqNullSafe(F.col("_of")))
    return counted.join(first, F.col(key) == F.col("_key")).select(id_column, key, "root_id", (F.col("_place") + F.col("_before")).cast("bigint").alias("seq"))


def suppress_repeats(rows: DataFrame, group: str, title: Column, company: Column, order: list[str]) -> DataFrame:
    """Drop a row without company whose title stood earlier in its group with one.

    Only the first row with a company per group and title matters, which is an
    aggregate; rows are not put in order.
    """
    named = F.coalesce(company, F.lit("")) != ""
    keyed = rows.withColumns({"_title": F.lower(title), "_named": named, "_at": F.struct(*order)})
    first = keyed.where("_named").groupBy(F.col(group).alias("_g"), F.col("_title").alias("_t")).agg(F.min("_at").alias("_first"))
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col("_title").eqNullSafe(F.col("_t"))
    kept = keyed.join(first, same, "left").where(F.col("_named") | F.col("_first").isNull() | (F.col("_at") < F.col("_first")))
    return kept.select(*rows.columns)


def throttle(rows: DataFrame, keys: list[str], time: str, seconds: int, id_column: str) -> DataFrame:
    """Keep a row only if its key had no *kept* row in the seconds before.

    The choice is greedy, so a chain of rows is walked in order, as a sorted
    stream that remembers one instant.  A key's time is cut into slots of
    ``seconds``: an empty slot ends a chain, so hot keys are split wherever they
    pause.  Rows without time are dropped.
    """
    step = seconds * 1_000_000
    timed = rows.where(F.col(time).isNotNull()).select(*keys, F.col(id_column).alias("_id"), F.unix_micros(time).alias("_at"))
    timed = timed.withColumn("_slot", F.floor(F.col("_at") / step))
    slots = timed.select(*keys, "_slot").distinct()
    w = Window.partitionBy(*keys).orderBy("_slot")
    new = F.coalesce((F.col("_slot") - F.lag("_slot").over(w) > 1).cast("int"), F.lit(1))
    chains = slots.withColumn("_new", new).withColumn("_chain", F.sum("_new").over(w)).drop("_new")
    chains = chains.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slot").alias("_s"), "_chain")
    same = F.col("_slot") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    walk = timed.join(chains, same).select(F.xxhash64(*keys, "_chain").alias("_of"), "_at", "_id")

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, 0
        for frame in frames:
            kept = []
            for of, at, i in zip(frame["_of"], frame["_at"], frame["_id"]):
                if of != chain or at - last >= step:
                    kept.append(i)
                    chain, last = of, at
            yield pd.DataFrame({"_id": kept}).astype({"_id": frame["_id"].dtype})

    kind = dict(rows.dtypes)[id_column]
    ordered = walk.repartition("_of").sortWithinPartitions("_of", "_at", "_id")
    kept = ordered.mapInPandas(keep, f"_id {kind}")
    return rows.join(kept.withColumnRenamed("_id", id_column), id_column, "left_semi")
