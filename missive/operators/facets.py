"""Optional filters and facets of lists: one plan, only the conditions asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators.reports import search


def matches(
    jobs: DataFrame, status: str = "", needle: str = "", least: float = 0.0, duplicates: bool = True, sort: str = "time", limit: int = 300,
    show: str = "",
) -> DataFrame:
    """Postings by optional filters; ``sort`` is time, score, score_asc or best, anything else is time.

    ``show="all"`` sets the threshold and the status aside.
    """
    rows = jobs if show == "all" else jobs.where(F.col("score") >= least)
    if status and show != "all":
        rows = rows.where(F.col("status") == status)
    if needle:
        rows = search(rows, needle, "title", "company", "location")
    if not duplicates:
        rows = rows.where("duplicate_of IS NULL")
    orders = {
        "score": [F.desc("score"), F.desc("received_at"), F.asc("id")],
        "score_asc": [F.asc("score"), F.desc("received_at"), F.asc("id")],
        "best": [F.desc("score"), F.asc("id")],
    }
    return rows.orderBy(*orders.get(sort, [F.desc("received_at"), F.desc("score"), F.asc("id")])).limit(limit)


def facet(mails: DataFrame, jobs: DataFrame, outreach: DataFrame, kind: str) -> DataFrame:
    """Mails with stored rows (jobs), without (norows), found but not stored (unstored), wanting an answer (followups), or other."""
    stored = jobs.select(F.col("message_id").alias("id"))
    asked = outreach.select(F.col("message_id").alias("id"))
    if kind == "jobs":
        return mails.join(stored, "id", "left_semi")
    if kind == "norows":
        return mails.where("category = 'job_alert'").join(stored, "id", "left_anti")
    if kind == "unstored":
        return mails.where("jobs_found > 0").join(stored, "id", "left_anti")
    if kind == "followups":
        return mails.join(asked, "id", "left_semi")
    return mails.where("category = 'other'")


def tags(**conditions: Column) -> Column:
    """Names of the conditions that hold, as an array."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())), lambda t: t.isNotNull())


def miss_columns(bare: Column, flagged: Column, expected: Column, titled: Column, stored: Column, thin: Column) -> list[Column]:
    """tags (joined by commas) and summary of a message's extraction: its most telling tag in words."""
    told = {
        "empty_body": (bare, F.lit("email body is nearly empty")),
        "zero_candidates": (titled == 0, F.lit("extractor found no postings")),
        "parsed_not_stored": ((titled > 0) & (stored == 0), F.concat(F.lit("parsed "), titled.cast("string"), F.lit(" titled posting(s), stored 0"))),
        "title_count_gap": (
            expected >= titled + 2,
            F.concat(F.lit("expected about "), expected.cast("string"), F.lit(" postings, extractor claimed "), titled.cast("string")),
        ),
        "thin_scrape": (thin > 0, F.lit("job rows exist but descriptions look empty or blocked")),
        "wrong_category": (flagged, F.lit("wrong category")),
    }
    words = F.concat(F.lit("parsed "), titled.cast("string"), F.lit(", stored "), stored.cast("string"))
    for name in reversed(("parsed_not_stored", "title_count_gap", "thin_scrape", "empty_body", "zero_candidates", "wrong_category")):
        words = F.when(told[name][0], told[name][1]).otherwise(words)
    return [F.array_join(tags(**{n: c for n, (c, _) in told.items()}), ",").alias("tags"), words.alias("summary")]


def unique_by_id(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row per key; rows without key all stay."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
