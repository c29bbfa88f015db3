"""Mailbox payloads (nested MIME as JSON text) to flat mail records."""

from __future__ import annotations

import base64
import binascii
import json
from email.utils import parseaddr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from missive.functions import html

#: Fixed value: a plain part of at least so many characters is taken for the body.
PLAIN_LEAST = 400

_RECORD = StructType(
    [StructField(n, StringType()) for n in ("sender_name", "sender_email", "recipient", "subject", "message_id", "text", "html")]
    + [StructField("part_types", ArrayType(StringType()))]
)
_ARROW = pa.struct(
    [(n, pa.string()) for n in ("sender_name", "sender_email", "recipient", "subject", "message_id", "text", "html")]
    + [("part_types", pa.list_(pa.string()))]
)


def decode(data: str) -> str:
    """Text of a URL-safe base64 part; undecodable bytes are replaced."""
    try:
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        return ""


def parse_payload(payload: str | None) -> dict | None:
    """Headers and bodies of one payload, or null if it isn't a JSON object."""
    try:
        root = json.loads(payload or "")
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    headers = {str(h.get("name") or "").lower(): str(h.get("value") or "") for h in root.get("headers") or [] if isinstance(h, dict)}
    bodies: dict[str, list[str]] = {}
    kinds, stack = [], [root]
    while stack:
        part = stack.pop()
        kind = str(part.get("mimeType", "")).lower()
        kinds.append(kind)
        if data := (part.get("body") or {}).get("data"):
            bodies.setdefault(kind, []).append(decode(data))
        stack += part.get("parts") or []
    name, address = parseaddr(headers.get("from", ""))
    return {
        "sender_name": name,
        "sender_email": address.lower(),
        "recipient": headers.get("to", ""),
        "subject": headers.get("subject", ""),
        "message_id": headers.get("message-id", "").strip("<>"),
        "text": "\n".join(bodies.get("text/plain", [])),
        "html": "\n".join(bodies.get("text/html", [])),
        "part_types": kinds,
    }


@F.arrow_udf(_RECORD)
def _parse(column: pa.Array) -> pa.Array:
    return pa.array([parse_payload(v) for v in column.to_pylist()], _ARROW)


def parse_mail(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw mailbox rows (id, threadId, snippet, internalDate, payload) to mail records."""
    parsed = raw.withColumn("m", _parse(F.col(payload)))
    return parsed.select(
        F.col("id"), F.col("threadId").alias("thread_id"), F.col("snippet"),
        F.timestamp_millis(F.col("internalDate").try_cast("bigint")).alias("received_at"), "m.*",
        body(F.col("m.text"), F.col("m.html")).alias("body"),
    )


def body(plain: Column, markup: Column) -> Column:
    """The plain part if it is long enough, else the longer of it and the text of the HTML part."""
    p = F.coalesce(plain, F.lit(""))
    from_html = F.coalesce(html.html_to_text(markup), F.lit(""))
    return F.when(F.length(p) >= PLAIN_LEAST, p).when(F.length(from_html) > F.length(p), from_html).otherwise(p)


def base64url(data: Column) -> Column:
    """Text of URL-safe base64, in the JVM; null if it isn't base64."""
    return F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64")).cast("string")


def sender_domain(address: Column) -> Column:
    return F.lower(F.substring_index(F.coalesce(address, F.lit("")), "@", -1))
