"""Bodies of posting pages without metadata: chrome left out, walls and stopovers told apart, and where boards give JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from missive import fixed
from missive.functions.digest import VOID, Page, _Reader
from missive.functions.html import squeeze

_c = {
    name: re.compile(getattr(fixed, name))
    for name in ("BODY_CLASS", "FORM_PAGE", "BLOCKED_PAGE", "STOPOVER_PAGE", "MENU_PAGE", "POSTING_WORDS", "SHELL_TITLE")
}
_FORWARD = (
    re.compile(r"(?is)if you are not redirected[^<]{0,120}<a[^>]+href=[\"'](https?://[^\"']+|/[^\s\"']+)[\"']"),
    re.compile(r"(?i)<meta[^>]+http-equiv=[\"']refresh[\"'][^>]+content=[\"'][^\"']*url=([^\"']+)"),
)


class _PageReader(_Reader):
    """Text outside chrome, elements that may be the body, title and metadata."""

    def __init__(self) -> None:
        super().__init__()
        self.meta: dict[str, str] = {}
        self.title: list[str] = []
        self.bodies: list[int] = []
        self.chrome: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta" and (name := given.get("property") or given.get("name")):
            self.meta.setdefault(name.lower(), squeeze(given.get("content") or ""))
        if tag in fixed.CHROME:
            self.chrome.append(tag)
        super().handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("main", "article") or _c["BODY_CLASS"].search(given.get("class") or "")):
            self.bodies.append(self.open[-1])

    def handle_endtag(self, tag):
        if tag in self.chrome:
            while self.chrome and self.chrome.pop() != tag:
                pass
        super().handle_endtag(tag)

    def handle_data(self, data):
        if self.page.elements[self.open[-1]][0] == "title":
            self.title.append(data)
        elif not self.chrome:
            super().handle_data(data)


def _text(page: Page, element: int) -> str:
    _, start, end, _ = page.elements[element]
    return squeeze("\n".join(x.strip() for x in page.pieces[start:end]))


def is_stopover(title: str, body: str) -> bool:
    """A cookie wall, a redirect or bare menus instead of a posting."""
    menu = _c["MENU_PAGE"].search(body[: fixed.MENU_WITHIN]) and not _c["POSTING_WORDS"].search(body)
    return bool(_c["STOPOVER_PAGE"].search(f"{title}\n{body[: fixed.STOPOVER_WITHIN]}") or menu)


def read_body(markup: str) -> dict[str, str]:
    """title, company, description and status (ok, blocked or empty) of a page."""
    reader = _PageReader()
    try:
        reader.feed(markup)
        reader.close()
    except (AssertionError, ValueError):
        pass
    page = reader.page
    for element in page.elements:
        if element[2] < element[1]:
            element[2] = len(page.pieces)
    best = max((_text(page, i) for i in reader.bodies), key=len, default="")
    body = best if len(best) > fixed.BODY_LEAST else _text(page, 0)
    title = reader.meta.get("og:title") or squeeze(" ".join(reader.title))
    if _c["SHELL_TITLE"].search(title) or is_stopover(title, body):
        named = re.search(r"(?i)you are now being redirected to\s+([^\n.<]+)", body)
        return {"title": "", "company": named.group(1).strip()[:150] if named else "", "description": "", "status": "empty"}
    blocked = len(body) < fixed.BLOCKED_MOST and bool(_c["BLOCKED_PAGE"].search(body[: fixed.BLOCKED_WITHIN]))
    usable = bool(body) and not blocked and not _c["FORM_PAGE"].search(body[: fixed.FORM_WITHIN])
    return {"title": title[:200], "company": reader.meta.get("og:site_name", "")[:150], "description": body[:20000],
            "status": "blocked" if blocked else "ok" if usable else "empty"}


def forward_to(markup: Column) -> Column:
    """The address a stopover page leads to, as written; '' if it names none."""
    text = F.coalesce(markup, F.lit(""))
    widget = F.when(F.lower(F.get_json_object(text, "$.widget")) == "redirect", F.get_json_object(text, "$.url"))
    told = [F.nullif(F.trim(F.regexp_extract(text, p.pattern, 1)), F.lit("")) for p in _FORWARD]
    return F.coalesce(widget, *told, F.lit(""))


def api_target(key: Column, url: Column) -> Column:
    """struct<target, parser>: where a board gives a posting as data, else its own page as html."""
    both = F.concat(F.coalesce(key, F.lit("")), F.lit(" "), F.coalesce(url, F.lit("")))
    case = F.struct(F.coalesce(url, F.lit("")).alias("target"), F.lit("html").alias("parser"))
    for pattern, form, parser in reversed(fixed.API_TARGETS):
        whole = pattern if pattern.endswith("$") else pattern + ".*$"
        hit = F.struct(F.regexp_replace(both, whole, form).alias("target"), F.lit(parser).alias("parser"))
        case = F.when(both.rlike(pattern), hit).otherwise(case)
    return case
