"""Where an incremental ingest goes on: bounds of the next read, what is committed after it, and metrics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

#: Seconds that a read reaches back behind its cursor; rows met twice are dropped by id.
OVERLAP = 300
RUN = "run_id string, batch_id bigint, started_at string, rows bigint, rows_per_second double, seconds double"


def read_bounds(cursor: int | None, origin: int, now: int, overlap: int = OVERLAP) -> tuple[int, int]:
    """Half-open [start, end) in epoch seconds of the next read: from the overlap behind the cursor, never before the origin."""
    start = origin if cursor is None else max(origin, cursor - overlap)
    return start, max(start, now)


def exclusive_after(start: int) -> int:
    """The value for a source whose lower bound leaves its own second out."""
    return start - 1


def committed(cursor: int | None, window_end: int | None, newest: int | None, frozen: bool) -> int | None:
    """The cursor after a run: unmoved while frozen, the window's end if it has one, else the newest row seen; never back."""
    if frozen:
        return cursor
    to = window_end if window_end is not None else newest
    return cursor if to is None else to if cursor is None else max(cursor, to)


def run_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """A row for each recent batch of a query (``RUN``)."""
    rows = [
        (str(p["runId"]), int(p["batchId"]), str(p["timestamp"]), int(p.get("numInputRows") or 0), float(p.get("processedRowsPerSecond") or 0.0),
         float((p.get("durationMs") or {}).get("triggerExecution") or 0) / 1000.0)
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, RUN)
