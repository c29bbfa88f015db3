"""Incremental ingest: the same expressions as in batch, on streams.

Offsets live in the checkpoint, so an interrupted query goes on where it
stopped; an overlapping re-read is dropped by id within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key did not occur before within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, label: str, width: str, delay: str) -> DataFrame:
    """Counts per tumbling window and label: window_start_s, label, n."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), label).agg(F.count("*").alias("n"))
    return counted.select(F.unix_seconds(F.col("w.start")).alias("window_start_s"), label, "n")


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote."""
    target = f"{folder}/data"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

    run = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.parquet(target)


def idempotent_sink(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer whose batches may be written again without doubling rows.

    Each batch is a partition of its own, ``batch=<id>``, so a batch that is repeated
    after a failure replaces itself and no stored row is read.  Keys are single
    within a batch; across batches ``deduplicated`` sees to that.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def throttled(stream: DataFrame, key: str, time: str, id_column: str, seconds: int) -> DataFrame:
    """Rows at least ``seconds`` after the last kept row of their key; state is one instant per key."""

    def keep(values: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([time, id_column])
        kept = []
        for i, t in zip(rows[id_column], rows[time].astype("int64") // 1000):
            if last is None or t - last >= seconds * 1_000_000:
                kept.append(i)
                last = t
        state.update((int(last),))
        yield pd.DataFrame({key: [values[0]] * len(kept), id_column: kept})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(
        keep, f"{key} {kinds[key]}, {id_column} {kinds[id_column]}", "last bigint", "append", GroupStateTimeout.NoTimeout
    )
