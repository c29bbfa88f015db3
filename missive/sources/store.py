"""Stored tables as logs: appends by batch, updates by action, state by key, purges by rewrite.

Parquet has no MERGE.  A table is a folder of batches, each of which a repeated
run replaces, so nothing is doubled after a failure; what is current is a fold
of the log.  All paths are in a folder that every machine shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "key string, value string, at timestamp"
ACTION = "table string, id string, field string, value string, at timestamp"
#: Tables that a general clearing empties; the others stay.
CLEARED = ("application_event", "application", "outreach", "job", "message")


class Store:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def append(self, name: str, rows: DataFrame, batch: int | str) -> None:
        """Add rows as one batch; the same batch again replaces itself."""
        rows.write.mode("overwrite").parquet(f"{self._path(name)}/batch={batch}")

    def read(self, name: str, schema: str) -> DataFrame:
        """All rows of a table, empty if nothing was stored yet; columns added later are null in older batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name) + "/batch=*")

    def clear(self, batch: str, schemas: dict[str, str]) -> None:
        """Empty the tables of ``CLEARED`` among ``schemas``; state, runs and reports stay."""
        for name in CLEARED:
            if name in schemas:
                self.replace(name, self.spark.createDataFrame([], schemas[name]), batch)

    def replace(self, name: str, rows: DataFrame, batch: str) -> None:
        """Make ``rows`` the whole table; they may be read from it, so they are written before old batches go."""
        fresh = f"{self.folder}/.next/{name}"
        rows.write.mode("overwrite").parquet(f"{fresh}/batch={batch}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        old, new = hadoop(self._path(name)), hadoop(fresh)
        system = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.delete(old, True)
        system.rename(new, old)


def newest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The current row of each key: the last by ``at``, ties by the rest of the row."""
    rest = [c for c in log.columns if c not in keys and c != at]
    return log.groupBy(*keys).agg(F.max_by(F.struct(at, *rest), F.struct(at, *rest)).alias("r")).select(*keys, "r.*")


def acted(rows: DataFrame, actions: DataFrame, table: str, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the last value that actions (``ACTION``) gave each of ``fields``; others keep theirs.

    Rows without actions aren't moved but for the join on their key.
    """
    own = actions.where((F.col("table") == table) & F.col("field").isin(*fields))
    last = newest(own.select("id", "field", "value", "at"), ["id", "field"], "at")
    given = last.groupBy("id").agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"_{f}") for f in fields))
    joined = rows.join(given.withColumnRenamed("id", "_id"), F.col(key).cast("string") == F.col("_id"), "left")
    kinds = dict(rows.dtypes)
    new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value").try_cast(kinds[f])).otherwise(F.col(f)) for f in fields}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in rows.columns))


def once(events: DataFrame, entity: str, message: str, order: list[str]) -> DataFrame:
    """One event per entity and message, the last by ``order``; events without message all stay."""
    named = F.coalesce(message, F.lit("")) != ""
    packed = F.struct(*events.columns)
    last = events.where(named).groupBy(entity, message).agg(F.max_by(packed, F.struct(*order)).alias("r")).select("r.*")
    return last.unionByName(events.where(~named).distinct())


def line(payload: str, key: str):
    """A JSON object of a payload column: itself if it is one, else wrapped with its key."""
    text = F.col(payload)
    shaped = F.try_parse_json(text)
    is_object = F.startswith(F.schema_of_variant(shaped), F.lit("OBJECT"))
    wrapped = F.to_json(F.struct(F.col(key).alias("message_id"), text.alias("payload")))
    bare = F.to_json(F.struct(F.col(key).alias("message_id")))
    return F.when(F.coalesce(text, F.lit("")) == "", bare).when(F.coalesce(is_object, F.lit(False)), text).otherwise(wrapped)


def export_lines(rows: DataFrame, payload: str, key: str, time: str, path: str, most: int = 2000) -> None:
    """The newest ``most`` payloads, one JSON object a line."""
    newest_rows = rows.orderBy(F.desc(time), F.desc(key)).limit(most)
    newest_rows.select(F.regexp_replace(line(payload, key), r"\s*[\r\n]+\s*", " ").alias("value")).write.mode("overwrite").text(path)


def record_files(rows: DataFrame, payload: str, key: str, path: str) -> None:
    """A file ``<key>.json`` for each record and an ``_index`` of their names; runs on the executors."""
    from missive.sources.sinks import safe_name

    named = rows.select(safe_name(F.col(key)).alias("name"), line(payload, key).alias("body"), F.col(key).alias("message_id"))

    def write(part) -> None:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(folder, recursive=True)
        for row in part:
            with system.open_output_stream(f"{folder}/{row.name}.json") as out:
                out.write(row.body.encode())

    named.foreachPartition(write)
    named.select("message_id", F.concat("name", F.lit(".json")).alias("file")).write.mode("overwrite").json(f"{path}/_index")


