"""Mailbox exports as sources, batch and stream.

A mailbox is a folder of newline-delimited JSON payloads.  ``register`` also
offers it as a data source of its own, ``format("mailbox")``, split by file.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, threadId string, snippet string, internalDate string, labelIds array<string>, payload string"


def read_mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows; the nested payload stays JSON text because its depth has no bound."""
    return spark.read.schema(SCHEMA).json(folder)


def newest_ids(mails: DataFrame, most: int, since_ms: int = 0) -> DataFrame:
    """At most ``most`` ids of messages received since an instant, newest first."""
    at = F.col("internalDate").try_cast("bigint")
    return mails.where(at >= since_ms).orderBy(at.desc(), "id").limit(most).select("id")


def stream_mailbox(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def decode_push(data: Column, schema: str) -> Column:
    """The JSON of a base64 push envelope; null where it is malformed."""
    return F.from_json(F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64")).cast("string"), schema)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(folder: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, "*.json*")))


def _rows(path: str) -> Iterator[tuple]:
    with open(path, encoding="utf-8") as file:
        for text in file:
            try:
                row = json.loads(text)
            except ValueError:
                continue
            payload = row.get("payload")
            yield (
                row.get("id"), row.get("threadId"), row.get("snippet"), row.get("internalDate"), row.get("labelIds") or [],
                payload if isinstance(payload, str) or payload is None else json.dumps(payload),
            )


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition.path)


class _StreamReader(DataSourceStreamReader):
    """New files by name; the offset is the name of the last file read, so exports must be named in order."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return {"after": os.path.basename(files[-1]) if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p) for p in _files(self.folder) if start["after"] < os.path.basename(p) <= end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition.path)


class MailboxSource(DataSource):
    """``spark.read.format("mailbox").load(folder)``; malformed lines are skipped."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MailboxSource)
