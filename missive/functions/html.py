"""HTML functions on the standard parser, batched through Arrow.

Null gives null, malformed markup never raises.
"""

from __future__ import annotations

import html
import json
import re
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from missive import fixed
from missive.functions.text import DATE_ISO

SILENT = {"script", "style", "head", "noscript", "template"}
LINK_TEXT_MOST = 200


class _Reader(HTMLParser):
    """Text, links, title, metadata and JSON-LD blocks of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: dict[str, list[str]] = {}
        self.meta: dict[str, str] = {}
        self.title: list[str] = []
        self.headline: list[str] = []
        self.blocks: list[str] = []
        self._silent = 0
        self._href: str | None = None
        self._in = {"title": 0, "h1": 0}
        self._json = False

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "script" and "ld+json" in (found.get("type") or ""):
            self._json = True
            self.blocks.append("")
        if tag in SILENT:
            self._silent += 1
        if tag in self._in:
            self._in[tag] += 1
        if tag == "meta" and (name := found.get("property") or found.get("name")):
            self.meta.setdefault(name.lower(), found.get("content") or "")
        if tag == "a" and (found.get("href") or "").startswith("http"):
            self._href = found["href"]
            self.links.setdefault(self._href, [])

    def handle_endtag(self, tag):
        if tag == "script":
            self._json = False
        if tag in SILENT and self._silent:
            self._silent -= 1
        if tag in self._in and self._in[tag]:
            self._in[tag] -= 1
        if tag == "a":
            self._href = None

    def handle_data(self, data):
        if self._json:
            self.blocks[-1] += data
            return
        if self._in["title"]:
            self.title.append(data)
        if self._silent:
            return
        if self._in["h1"]:
            self.headline.append(data)
        if data.strip():
            self.text.append(data.strip())
        if self._href is not None and data.strip():
            self.links[self._href].append(data.strip())


def read(markup: str) -> _Reader:
    reader = _Reader()
    try:
        reader.feed(markup)
        reader.close()
    except (AssertionError, ValueError):
        pass
    return reader


def squeeze(text: str) -> str:
    text = text.replace("‌", "").replace(" ", " ")
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _posting(blocks: list[str]) -> dict:
    """The first JobPosting among JSON-LD blocks; control characters are forgiven."""
    todo = []
    for block in blocks:
        try:
            todo.append(json.loads(re.sub(r"[\x00-\x1f]", " ", block)))
        except ValueError:
            continue
    while todo:
        item = todo.pop(0)
        if isinstance(item, list):
            todo = item + todo
        elif isinstance(item, dict):
            kind = item.get("@type")
            if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                return item
            todo += item.get("@graph") or []
    return {}


def _one(value):
    """The first of a list, or the value itself."""
    return (value[0] if value else None) if isinstance(value, list) else value


def pay_range(posting: dict) -> str:
    """``currency low–high /unit`` of a JSON-LD posting; '' if it states no amount."""
    base = _one(posting.get("baseSalary") or posting.get("estimatedSalary"))
    if not isinstance(base, dict):
        return ""
    value = base.get("value") or base.get("minValue")
    inner = value if isinstance(value, dict) else {}
    low = inner.get("minValue") or inner.get("value") or base.get("minValue") or (value if not inner else None)
    high = (inner.get("maxValue") or base.get("maxValue")) if inner else None
    if not low:
        return ""
    unit = str(inner.get("unitText") or base.get("unitText") or "") if inner else ""
    amount = f"{low}–{high}" if high and str(high) != str(low) else str(low).strip()
    return " ".join(filter(None, [str(base.get("currency") or "USD"), amount, {"HOUR": "/hour", "YEAR": "/year"}.get(unit, unit)]))


def posted_day(posting: dict) -> str:
    """The ISO day a JSON-LD posting was published on, else what it says, clipped."""
    told = str(posting.get("datePosted") or posting.get("dateCreated") or "")
    day = re.search(DATE_ISO, told)
    if day:
        return day.group(1)
    try:
        return datetime.fromisoformat(told.replace("Z", "+00:00")).date().isoformat()
    except ValueError:
        return told[:32]


def employment_kind(posting: dict) -> str:
    """The label of a JSON-LD posting's first kind of employment."""
    told = str(_one(posting.get("employmentType") or "") or "")
    return fixed.EMPLOYMENT_CODES.get(told.upper().replace(" ", "_"), told.replace("_", " ").title()[:40])


@F.arrow_udf(StringType())
def _unescape(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in column.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _to_text(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else squeeze("\n".join(read(v).text)) for v in column.to_pylist()], pa.string())


_LINK = StructType([StructField("url", StringType()), StructField("text", StringType())])


@F.arrow_udf(ArrayType(_LINK))
def _links(column: pa.Array) -> pa.Array:
    rows = [
        None if v is None else [{"url": u, "text": " ".join(t)[:LINK_TEXT_MOST]} for u, t in read(v).links.items()]
        for v in column.to_pylist()
    ]
    return pa.array(rows, pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())])))


_FIELDS = ("title", "company", "location", "description", "posted_at", "employment_type", "salary", "extraction", "status")


def page_record(markup: str | None) -> dict[str, str] | None:
    """Fields of a posting page: JSON-LD first, else its body and metadata."""
    if markup is None:
        return None
    page = read(markup)
    out = dict.fromkeys(_FIELDS, "")
    found = _posting(page.blocks)
    if found:
        name = lambda x: x.get("name", "") if isinstance(x, dict) else str(x or "")
        place = found.get("jobLocation") or {}
        place = place[0] if isinstance(place, list) and place else place
        address = (place.get("address") or {}) if isinstance(place, dict) else {}
        parts = [address.get(k) for k in ("addressLocality", "addressRegion")] if isinstance(address, dict) else []
        out |= {
            "title": str(found.get("title") or ""),
            "company": name(found.get("hiringOrganization")),
            "location": ", ".join(p for p in parts if p),
            "description": squeeze("\n".join(read(str(found.get("description") or "")).text)),
            "posted_at": posted_day(found),
            "employment_type": employment_kind(found),
            "salary": pay_range(found),
            "extraction": "jsonld",
        }
        if found.get("jobLocationType") == "TELECOMMUTE":
            out["location"] = (out["location"] + " (Remote)").strip()
    else:
        from missive.functions.pages import read_body

        return out | read_body(markup) | {"extraction": "html"}
    out["status"] = "ok" if len(out["description"]) > 40 else "empty"
    return out


@F.arrow_udf(StructType([StructField(f, StringType()) for f in _FIELDS]))
def _page(column: pa.Array) -> pa.Array:
    return pa.array([page_record(v) for v in column.to_pylist()], pa.struct([(f, pa.string()) for f in _FIELDS]))


def unescape(text: Column) -> Column:
    """Character references resolved."""
    return _unescape(text)


def html_to_text(markup: Column) -> Column:
    """Readable text, one text node per line; scripts, styles and the head left out."""
    return _to_text(markup)


def html_links(markup: Column) -> Column:
    """array<struct<url, text>> of different absolute links in document order."""
    return _links(markup)


def page_fields(markup: Column) -> Column:
    """struct of the fields of a posting page."""
    return _page(markup)
