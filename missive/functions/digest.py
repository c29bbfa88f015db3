"""Postings listed in a digest mail: one mail to many candidates.

A page is read once into a row of text pieces and the intervals of its elements
over them, so an ancestor is an interval around another and the text of any part
is a slice.  A posting's card is the widest interval around its link that holds
links to no other posting.  The lines of a card are told apart by ordered tests.

Defined results: null or empty markup gives what links the plain text holds;
malformed markup never raises; links without a title are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from missive import fixed
from missive.functions import urls
from missive.functions.html import squeeze

# Bounds of cards, lines and fields.
LEVELS_MOST, LINES_MOST, BEFORE_MOST = 10, 16, 12
TITLE_MOST, NAME_MOST, CONTEXT_MOST = 200, 150, 600
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "head", "title"}
ROOTS = {"", "html", "body"}

_p = {
    name: re.compile(getattr(fixed, name))
    for name in ("FOOTER_TEXT", "NOISE_LINE", "LOCATION_HINT", "PAY_LINE", "TITLE_HINT", "TITLE_ROLE", "COMPANY_HINT", "JUNK_TITLE", "APPLY_CALL", "ADDRESS_LINE")
}
_SNIPPET = re.compile(r"(?i)^(job summary|we are|we.re|would you like|.+ seeks |logistics at)")
_PLACE = re.compile(
    r"(?i)\b(united states|canada|india|europe|new york|san francisco|seattle|austin|boston|chicago|dallas|atlanta|denver)\b"
)
_PLACE_START = re.compile(r"(?i)^(remote|hybrid|on-?site)\b")
_STATE_END = re.compile(r",\s*[A-Z]{2}\b")
_NO_COMPANY = re.compile(
    r"(?i)^(opportunities|careers|jobs|hiring|talent acquisition|job alerts?|just posted!?|jobseekers?|posted\b|open to offers|twine team|what you can expect)\b"
)
_MORE_JOBS = re.compile(r"(?i)\d+\s+more jobs")
_LINK = re.compile(r"https?://[^\s<>\"')]+")


@dataclass
class Page:
    """Pieces of text in order; elements as (tag, first piece, end, parent); links as (href, element)."""

    pieces: list[str] = field(default_factory=list)
    elements: list[list] = field(default_factory=lambda: [["", 0, -1, -1]])
    links: list[tuple[str, int]] = field(default_factory=list)

    def lines(self, start: int, end: int) -> list[str]:
        return [x for x in squeeze("\n".join(self.pieces[start:end])).split("\n") if x.strip()]

    def of(self, element: int) -> list[str]:
        _, start, end, _ = self.elements[element]
        return self.lines(start, end)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open = [0]
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.page.elements.append([tag, len(self.page.pieces), -1, self.open[-1]])
        self.open.append(len(self.page.elements) - 1)
        self.silent += tag in SILENT
        href = (dict(attrs).get("href") or "").strip() if tag == "a" else ""
        if href.lower().startswith("http"):
            self.page.links.append((href, self.open[-1]))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.page.elements[self.open[i]][0] == tag), None)
        while at is not None and len(self.open) > at:
            element = self.page.elements[self.open.pop()]
            element[2] = len(self.page.pieces)
            self.silent -= element[0] in SILENT

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.page.pieces.append(data)


def read_page(markup: str) -> Page:
    reader = _Reader()
    try:
        reader.feed(markup)
        reader.close()
    except (AssertionError, ValueError):
        pass
    for element in reader.page.elements:
        if element[2] < element[1]:
            element[2] = len(reader.page.pieces)
    return reader.page


def is_footer(label: str, url: str) -> bool:
    """Whether a link leads away from postings, by its label or address."""
    both = f"{label} {url}".lower()
    return bool(_p["FOOTER_TEXT"].match(label.strip())) or any(part in both for part in fixed.FOOTER_PARTS)


def looks_like_card(text: str) -> bool:
    """Whether lines read like a posting: a place, a wage or a title besides noise."""
    text = text.strip()
    if len(text) < 8 or _p["FOOTER_TEXT"].match(text.split("\n", 1)[0].strip()):
        return False
    told = any(x.strip() and not _p["NOISE_LINE"].match(x.strip()) for x in text.split("\n"))
    return bool(_p["PAY_LINE"].search(text) or (told and (_p["LOCATION_HINT"].search(text) or _p["TITLE_HINT"].search(text))))


def is_place(line: str) -> bool:
    if _p["TITLE_HINT"].search(line) or _p["COMPANY_HINT"].search(line):
        return False
    if _STATE_END.search(line) or _PLACE_START.search(line):
        return True
    return bool((len(line) < 80 and _PLACE.search(line)) or (len(line) < 40 and _p["LOCATION_HINT"].search(line)))


def is_snippet(line: str) -> bool:
    """Running text rather than a field."""
    return len(line) > 70 or line.endswith(("...", "…")) or ("." in line and len(line) > 40) or bool(_SNIPPET.match(line)) or line.count(" ") >= 8


#: What a line of a card is; the first test that holds decides.  None drops the line.
_KINDS = (
    (lambda x: is_snippet(x) and not _p["TITLE_HINT"].search(x), None),
    (lambda x: _p["APPLY_CALL"].match(x) or _p["FOOTER_TEXT"].match(x), None),
    (lambda x: _p["COMPANY_HINT"].search(x) and not _p["TITLE_HINT"].search(x), "company"),
    (lambda x: len(x) < 180 and _p["TITLE_ROLE"].search(x), "title"),
    (lambda x: _p["PAY_LINE"].search(x), None),
    (lambda x: len(x) < 80 and is_place(x), "location"),
    (lambda x: len(x) < 80, "company"),
)


def card_fields(label: str, lines: list[str]) -> tuple[str, str, str]:
    """(title, company, location) told by a link's label and the lines of its card."""
    own = [x.strip() for x in label.split("\n") if x.strip()]
    told: list[str] = []
    for line in (*own, *(x for x in lines if x not in own)):
        line = re.sub(r"^\W+", "", line).strip(" ★·•")
        if line and not _p["NOISE_LINE"].match(line) and not re.match(r"\d+\.?\d*\s*★", line):
            told += [x for x in map(str.strip, re.split("[·•]", line)) if x]
    found: dict[str | None, list[str]] = {"title": [], "company": [], "location": [], None: []}
    for line in told:
        kind = next((k for test, k in _KINDS if test(line)), None)
        found[kind].append(re.split(r"\s*[$*]", line, maxsplit=1)[0].strip()[:140] or line[:140] if kind == "title" else line)
    titles, companies, places = found["title"], found["company"], found["location"]
    if not titles and companies:
        titles, companies = companies[:1], companies[1:]
    title, company = (titles or [""])[0], (companies or [""])[0]
    if not title:
        title = next((x for x in told if x not in places and x != company and not _p["PAY_LINE"].search(x) and not is_snippet(x)), "")
    if company and _p["TITLE_HINT"].search(company) and title and not _p["TITLE_HINT"].search(title):
        title, company = company, title
    if _p["JUNK_TITLE"].search(title):
        title = titles[1] if len(titles) > 1 else ""
    return title[:TITLE_MOST], company[:NAME_MOST], (places or [""])[0][:NAME_MOST]


def usable_label(label: str) -> bool:
    """Whether a link's label is a posting's title as it stands."""
    if not 6 <= len(label) <= 180 or any(_p[n].match(label) for n in ("APPLY_CALL", "FOOTER_TEXT", "NOISE_LINE")) or _p["JUNK_TITLE"].search(label):
        return False
    return not (_p["LOCATION_HINT"].search(label) and re.search(r"(?i)\b(the|about|would you)\b", label))


def role_like(text: str) -> bool:
    """Whether a line reads like a title of a job."""
    text = " ".join(text.split())
    if not 6 <= len(text) <= 180 or text.lower().startswith("http") or not _p["TITLE_ROLE"].search(text):
        return False
    return not (_p["JUNK_TITLE"].search(text) or any(_p[n].match(text) for n in ("APPLY_CALL", "FOOTER_TEXT", "NOISE_LINE")))


def title_like(text: str) -> bool:
    text = text.strip()
    return len(text) >= 6 and not _p["APPLY_CALL"].match(text) and not _p["JUNK_TITLE"].search(text)


# What names the employer behind an alert: the field, a pattern, and whether boards' own names are refused.
SENDER_RULES = (
    ("name", r"(?i)(?:careers|jobs|hiring|opportunities)(?:\s+at)?\s+(.+)", False),
    ("name", r"(?i)^(.+?)\s+(?:careers|jobs|hiring)\b", True),
    ("subject", r"(?i)new jobs posted from\s+(.+)", False),
    ("subject", r"(?i)(?:job alerts? for you from|alerts? for you from)\s+(.+)", True),
    ("subject", r"(?i)\bat\s+(.+?)(?:\.|$)", True),
    ("subject", r"(?i)\s@\s+(.+)$", True),
)
_BOARDS = ("linkedin", "indeed", "glassdoor", "haystack", "adzuna", "monster", "workday")
_NO_EMPLOYER = re.compile(r"(?i)noreply|no-reply|alerts?|mailer|jobs?alerts|opportunit|careers?")


def _is_board(name: str) -> bool:
    low = name.lower().strip()
    return any(low == b or low.startswith(b + " ") for b in _BOARDS)


def sender_company(name: str, address: str, subject: str) -> str:
    """The employer behind an alert: by the sender's name, the subject, the mailbox; '' if it is the board itself."""
    given = {"name": name, "subject": subject}
    for where, pattern, refuse in SENDER_RULES:
        if m := re.search(pattern, given[where]):
            told = m.group(1).strip(" .!")
            if "posted from" in pattern:
                told = re.sub(r"(?i)\.(jobs2web\.com|jobs)$", "", told).replace(".", " ").title()
            if not refuse or (told and not _is_board(told) and not _MORE_JOBS.search(told)):
                return told[:NAME_MOST]
    box = re.split(r"(?i)[-_.]?(?:am|a)?[-_.]?jobnotification", address.split("@")[0], maxsplit=1)[0]
    if box and not _NO_EMPLOYER.search(box):
        return re.sub(r"[._-]+", " ", box).title()[:NAME_MOST]
    own = name.strip(" .")
    return own if own and not _is_board(own) and len(own) < 60 else ""


class Digest:
    """Links of a page with what they lead to."""

    def __init__(self, markup: str):
        self.page = page = read_page(markup)
        self.links = []
        for href, element in page.links:
            label = "\n".join(page.of(element))
            target = urls.Parts(urls.unwrap(href))
            tracked = urls.counts_clicks(urls.Parts(href))
            self.links.append((href, element, label, target, tracked, urls.leads_to_posting(target)))
        # Where links to postings stand, so that those inside an interval are found by search.
        marks = [
            (page.elements[e][1], e, urls.key_of(t) if leads else href)
            for href, e, label, t, tracked, leads in self.links
            if (leads or tracked) and not is_footer(label, href)
        ]
        self.marks = sorted(marks)
        self.starts = [m[0] for m in self.marks]

    def keys_in(self, element: int) -> set[str]:
        """Keys of the postings linked within an element."""
        _, start, end, _ = self.page.elements[element]
        out = set()
        for at in range(bisect_left(self.starts, start), len(self.marks)):
            first, own, key = self.marks[at]
            if first > end or len(out) > 1:
                break
            if self.within(own, element):
                out.add(key)
        return out

    def within(self, inner: int, outer: int) -> bool:
        # Elements are numbered as they open, so an ancestor's number is smaller.
        while inner > outer:
            inner = self.page.elements[inner][3]
        return inner == outer

    def card(self, element: int) -> list[str]:
        """Lines of the widest ancestor that links to no other posting."""
        best, at = element, element
        for _ in range(LEVELS_MOST):
            at = self.page.elements[at][3]
            if at < 0 or self.page.elements[at][0] in ROOTS or len(self.keys_in(at)) > 1:
                break
            best = at
        return self.page.of(best)[:LINES_MOST]

    def before(self, element: int) -> list[str]:
        """Lines of the nearest card-like element before a link without any text."""
        parent = self.page.elements[element][3]
        siblings = [i for i in range(element - 1, max(parent, 0), -1) if self.page.elements[i][3] == parent]
        return next((x[:LINES_MOST] for i in siblings[:BEFORE_MOST] if looks_like_card("\n".join(x := self.page.of(i)))), [])


def _posting(digest: Digest, link: tuple, employer: str) -> dict | None:
    href, element, label, target, tracked, leads = link
    if is_footer(label, href) or is_footer(label, target.url) or (target.board == "ultipro" and not leads):
        return None
    lines = digest.card(element)
    if not lines and tracked:
        lines = digest.before(element)
    carded = looks_like_card(label) or looks_like_card("\n".join(lines) or label) or _p["APPLY_CALL"].match(label)
    if not leads and not (tracked and carded):
        return None
    to = target if leads or not tracked else urls.Parts(href)
    title, company, location = card_fields(label, lines)
    flat = " ".join(label.split())
    if usable_label(flat) and label.count("\n") < 3:
        title = flat
        low, name = title.lower(), company.lower()
        if name and (low == name or low.startswith((name.rstrip(" -–—") + " ", name + "-"))):
            company = ""
    if not company or is_snippet(company) or any(x.search(company) for x in (_p["JUNK_TITLE"], _NO_COMPANY, _p["APPLY_CALL"], _MORE_JOBS)):
        company = employer
    role = _p["TITLE_ROLE"].search(title)
    if not title.strip() or title.lower().startswith("http") or _p["JUNK_TITLE"].search(title) or _p["APPLY_CALL"].match(title):
        return None
    if not role and ((is_place(title) and (len(title) <= 24 or _p["ADDRESS_LINE"].search(title))) or _p["PAY_LINE"].search(title)):
        return None
    if not company and title == title.lower():
        return None
    source = to.board or ("appcast" if urls.counts_clicks(to) else "")
    return {"url": to.url, "url_key": urls.key_of(to), "title": title, "company": company, "location": location, "source": source,
            "context": " | ".join(lines)[:CONTEXT_MOST]}


def _unlinked(digest: Digest, found: dict[str, dict], employer: str) -> None:
    """Add innermost tables that read like cards but link to nothing."""
    page = digest.page
    tables = [i for i, e in enumerate(page.elements) if e[0] == "table"]
    outer = {page_parent for i in tables for page_parent in _ancestors(page, i)} & set(tables)
    linked = {a for _, e, *_ in digest.links for a in _ancestors(page, e)}
    known = {x["title"].lower() for x in found.values()}
    for i in tables:
        lines = page.of(i)[:LINES_MOST]
        if i in outer or i in linked or not looks_like_card("\n".join(lines)):
            continue
        title, company, location = card_fields("", lines)
        if not company or _p["JUNK_TITLE"].search(company) or _NO_COMPANY.search(company):
            company = employer
        if company and _p["TITLE_ROLE"].search(title) and not _p["JUNK_TITLE"].search(title) and title.lower() not in known:
            key = f"card:{company.lower()}:{title.lower()}"[:180]
            source = next((x["source"] for x in found.values() if x["source"]), "")
            found[key] = {"url": "", "url_key": key, "title": title, "company": company, "location": location, "source": source,
                          "context": " | ".join(lines)[:CONTEXT_MOST]}
            known.add(title.lower())


def _ancestors(page: Page, element: int):
    while (element := page.elements[element][3]) >= 0:
        yield element


def postings(markup: str | None, plain: str | None, name: str, address: str, subject: str, most: int) -> list[dict]:
    """At most ``most`` different postings of a mail, in order.

    Of several links to one posting the title that names a role counts, then the
    longer, then the first.  A title without company isn't listed again beside one with it.
    """
    employer = sender_company(name, address, subject)
    found: dict[str, dict] = {}
    digest = Digest(markup) if markup else None
    for link in digest.links if digest else ():
        new = _posting(digest, link, employer)
        if new is None or (not new["company"] and any(x["company"] and x["title"].lower() == new["title"].lower() for x in found.values())):
            continue
        rank = lambda x: (bool(_p["TITLE_ROLE"].search(x["title"])), len(x["title"]))
        old = found.get(new["url_key"])
        if old is None or rank(new) > rank(old):
            found[new["url_key"]] = new
        if len(found) >= most:
            break
    if digest and len(found) < most:
        _unlinked(digest, found, employer)
    if not found:
        for raw in _LINK.findall(plain or ""):
            to = urls.Parts(urls.unwrap(raw.rstrip(".,);")))
            if urls.leads_to_posting(to):
                found.setdefault(urls.key_of(to), {"url": to.url, "url_key": urls.key_of(to), "title": "", "company": employer, "location": "",
                                                   "source": to.board, "context": ""})
    return list(found.values())[:most]


FIELDS = ("url", "url_key", "title", "company", "location", "source", "context")
_POSTINGS = ArrayType(StructType([StructField(n, StringType()) for n in FIELDS]))
_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in FIELDS]))


def candidates(markup: Column, plain: Column, name: Column, address: Column, subject: Column, most: int = 40) -> Column:
    """``array<struct>`` of the postings of a mail."""

    @F.arrow_udf(_POSTINGS)
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([postings(h, t, n or "", a or "", s or "", most) for h, t, n, a, s in rows], _ARROW)

    return run(markup, plain, name, address, subject)


ANCHOR = ("label", "url", "url_key", "source")


def page_anchors(markup: str | None) -> list[dict]:
    """Different destinations of a page's links in order; footers and unlabelled links to nowhere known are left out."""
    out: dict[str, dict] = {}
    for href, _, label, target, tracked, leads in Digest(markup).links if markup else ():
        label = " ".join(label.split())[:160]
        jobish = bool(target.board) or tracked or leads
        if not is_footer(label, href) and (jobish or len(label) >= 3) and target.url not in out:
            out[target.url] = {"label": label, "url": target.url, "url_key": urls.key_of(target), "source": target.board, "jobish": jobish,
                               "is_posting": leads, "role_like": role_like(label), "title_like": title_like(label)}
    return list(out.values())


_TELLS = ("jobish", "is_posting", "role_like", "title_like")
_ANCHOR_TYPE = ArrayType(StructType([StructField(n, StringType()) for n in ANCHOR] + [StructField(n, BooleanType()) for n in _TELLS]))
_ANCHOR_ARROW = pa.list_(pa.struct([(n, pa.string()) for n in ANCHOR] + [(n, pa.bool_()) for n in _TELLS]))


@F.arrow_udf(_ANCHOR_TYPE)
def _anchors(column: pa.Array) -> pa.Array:
    return pa.array([page_anchors(v) for v in column.to_pylist()], _ANCHOR_ARROW)


def anchors(markup: Column) -> Column:
    """``array<struct>`` of a page's anchors with what each label reads like."""
    return _anchors(markup)


@F.arrow_udf(ArrayType(StringType()))
def _role_lines(column: pa.Array) -> pa.Array:
    return pa.array([[x for x in (v or "").splitlines() if role_like(x)] for v in column.to_pylist()], pa.list_(pa.string()))


def role_lines(text: Column) -> Column:
    """Lines of a text that read like titles of jobs."""
    return _role_lines(text)
