"""Postings as job boards' interfaces return them, read in the JVM with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from missive.functions import html
from missive.functions.text import first_filled

# Paths of the fields in each board's JSON: title, company, location, text, date.
BOARDS = {
    "greenhouse": ("$.title", "$.company_name", "$.location.name", "$.content", "$.updated_at"),
    "lever": ("$.text", "$.company", "$.categories.location", "$.description", "$.createdAt"),
    "ashby": ("$.title", "$.organizationName", "$.locationName", "$.descriptionHtml", "$.publishedDate"),
    "workday": ("$.jobPostingInfo.title", "$.hiringOrganization.name", "$.jobPostingInfo.location", "$.jobPostingInfo.jobDescription", "$.jobPostingInfo.startDate"),
    "smartrecruiters": ("$.name", "$.company.name", "$.location.city", "$.jobAd.sections.jobDescription.text", "$.releasedDate"),
    "workable": ("$.title", "$.company", "$.location.city", "$.description", "$.published"),
}


def board_fields(board: Column, payload: Column) -> Column:
    """struct<title, company, location, description, posted_at>; fields are '' where absent or malformed."""
    case: Column | None = None
    for name, paths in BOARDS.items():
        fields = F.struct(
            *(first_filled(F.get_json_object(payload, p)).alias(c) for c, p in zip(("title", "company", "location", "markup", "stamp"), paths))
        )
        case = F.when(board == name, fields) if case is None else case.when(board == name, fields)
    stamp = case["stamp"]
    day = F.when(stamp.rlike(r"^\d{12,}$"), F.date_format(F.timestamp_millis(stamp.try_cast("bigint")), "yyyy-MM-dd")).otherwise(F.substring(stamp, 1, 10))
    return F.when(
        case.isNotNull(),
        F.struct(
            case["title"].alias("title"), case["company"].alias("company"), case["location"].alias("location"),
            F.coalesce(html.html_to_text(html.unescape(case["markup"])), F.lit("")).alias("description"), F.coalesce(day, F.lit("")).alias("posted_at"),
        ),
    )


def first_link(links: Column, hosts: list[str], most: int = 400) -> Column:
    """The first URL of array<struct<url, text>> on one of the hosts; '' if none."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    known = F.array(*map(F.lit, hosts))
    hit = F.filter(links, lambda l: F.exists(known, lambda k: (host(l["url"]) == k) | F.endswith(host(l["url"]), F.concat(F.lit("."), k))))
    return F.substring(F.coalesce(F.get(hit, F.lit(0))["url"], F.lit("")), 1, most)
