"""Queries of reports and lists: windowed counts, funnels, briefs, top-k lists, misses.

A message may be stored more than once; its newest row counts.  Reports come as
rows of (metric, n), so that every table is read in one pass and nothing is joined.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive import fixed
from missive.functions import times
from missive.operators import dedup, facets, reports
from missive.plans.base import in_list, query, quoted
from missive.runtime import table

NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)
START, END = times.window_bounds(1, NOW, "2025-01-01", "2025-03-31")
LABELS = {
    "job_alert": "Job alerts", "recruiter_outreach": "Recruiter outreach", "interview_invite": "Interview invites", "assessment": "Assessments",
    "next_step": "Next steps asked of you", "offer": "Offers", "rejection": "Rejections", "application_update": "Application updates",
    "other": "Everything else",
}
FOLLOW_UPS = ("offer", "interview_invite", "assessment", "next_step", "recruiter_outreach")
STAGES = ("applied", "in_review", "next_step", "assessment", "interview", "offer")
EXITS = ("rejected", "withdrawn")

_WIN = "{c} >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND {c} < TIMESTAMPTZ '2025-04-01 00:00:00+00'"
_IN = _WIN.format(c="received_at")
_MAIL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY processed_at DESC, {tie}) AS r FROM message) WHERE r = 1)"
_FOLLOW = f"NOT handled AND kind IN ({in_list(FOLLOW_UPS)})"


def mail_sql(*columns: str) -> str:
    """The newest row of every message; equal times end at the least of ``columns``."""
    return _MAIL.format(tie=", ".join(f"{c} NULLS FIRST" for c in columns))


def newest_mail(spark, d, *columns: str) -> DataFrame:
    """id and ``columns`` of the newest row of every message."""
    rows = table(spark, d, "message").select("id", "processed_at", *columns)
    return dedup.best_per_key(rows, ["id"], [-F.unix_micros("processed_at"), *(F.col(c) for c in columns)]).drop("processed_at")


def in_window(column: str, start=START, end=END) -> Column:
    """Half open: from ``start`` to before ``end``."""
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def _open_follow_up() -> Column:
    return ~F.col("handled") & F.col("kind").isin(*FOLLOW_UPS)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# -- breakdown -------------------------------------------------------------------
_LABEL_ROWS = " UNION ALL ".join(f"SELECT {i} AS position, {quoted(k)} AS category, {quoted(v)} AS label" for i, (k, v) in enumerate(LABELS.items()))


@query(
    "breakdown_window",
    f"""SELECT coalesce(k.category, c.category) AS category, coalesce(k.label, c.category) AS label, coalesce(k.position, 9) AS position, CAST(coalesce(c.n, 0) AS bigint) AS n
    FROM ({_LABEL_ROWS}) k FULL JOIN (SELECT category, count(*) AS n FROM {mail_sql('category')} WHERE {_IN} GROUP BY 1) c ON k.category = c.category""",
)
def _breakdown(spark, d):
    """Messages by category in a window, zero filled in the order of the labels; others follow, titled by themselves."""
    mails = newest_mail(spark, d, "category", "received_at").where(in_window("received_at"))
    counted = reports.zero_filled(mails, "category", list(LABELS)).withColumnRenamed("label", "category")
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    title = F.initcap(F.replace("category", F.lit("_"), F.lit(" ")))
    return counted.select("category", F.coalesce(F.try_element_at(names, F.col("category")), title).alias("label"), "position", "n")


_MAIL_SUMS = {
    "messages": "count(*)", "acknowledgements": "count(*) FILTER (WHERE category = 'application_update')",
    "rejections": "count(*) FILTER (WHERE category = 'rejection')", "unclassified": "count(*) FILTER (WHERE category = 'other')",
    "not_job_mail": "count(*) FILTER (WHERE category <> 'job_alert')", "jobs_found": "coalesce(sum(jobs_found), 0)",
}
_JOB_SUMS = {
    "jobs_stored": "count(*)", "jobs_matched": "count(*) FILTER (WHERE matched)", "jobs_ignored": "count(*) FILTER (WHERE NOT matched)",
    "jobs_duplicates": "count(*) FILTER (WHERE duplicate_of IS NOT NULL)",
}


def _metrics_sql(sums: dict[str, str], source: str) -> str:
    columns = ", ".join(f"CAST({e} AS bigint) AS {n}" for n, e in sums.items())
    return f"SELECT metric, n FROM (UNPIVOT (SELECT {columns} FROM {source}) ON {', '.join(sums)} INTO NAME metric VALUE n)"


@query(
    "breakdown_totals",
    _union_sql([
        _metrics_sql(_MAIL_SUMS, f"{mail_sql('category', 'jobs_found')} WHERE {_IN}"), _metrics_sql(_JOB_SUMS, f"job WHERE {_IN}"),
        f"SELECT 'outreach_open', CAST(count(*) AS bigint) FROM outreach WHERE {_FOLLOW} AND {_IN}",
        "SELECT 'applications_open', CAST(count(*) AS bigint) FROM application WHERE NOT closed",
    ]),
)
def _totals(spark, d):
    """Counts of a window over four tables; open applications are a running total."""
    c = F.col
    mails = newest_mail(spark, d, "category", "received_at", "jobs_found").where(in_window("received_at"))
    jobs = table(spark, d, "job").where(in_window("received_at"))
    is_ = lambda k: F.count_if(c("category") == k)
    return _union([
        reports.metrics(mails, messages=F.count("*"), acknowledgements=is_("application_update"), rejections=is_("rejection"), unclassified=is_("other"),
                        not_job_mail=F.count_if(c("category") != "job_alert"), jobs_found=F.coalesce(F.sum("jobs_found"), F.lit(0))),
        reports.metrics(jobs, jobs_stored=F.count("*"), jobs_matched=F.count_if("matched"), jobs_ignored=F.count_if(~c("matched")),
                        jobs_duplicates=F.count_if(c("duplicate_of").isNotNull())),
        reports.metrics(table(spark, d, "outreach").where(in_window("received_at")), outreach_open=F.count_if(_open_follow_up())),
        reports.metrics(table(spark, d, "application"), applications_open=F.count_if(~c("closed"))),
    ])


@query(
    "breakdown_groups",
    _union_sql([
        "SELECT 'application_status' AS grouping_, coalesce(nullif(status, ''), 'unknown') AS label, CAST(count(*) AS bigint) AS n FROM application GROUP BY 2",
        f"SELECT 'scrape_status', coalesce(nullif(scrape_status, ''), 'unknown'), CAST(count(*) AS bigint) FROM job WHERE {_IN} GROUP BY 2",
        f"SELECT 'source', coalesce(nullif(source, ''), 'unknown'), CAST(count(*) AS bigint) FROM job WHERE {_IN} GROUP BY 2",
        f"SELECT 'email_type', coalesce(nullif(email_type, ''), 'unclassified'), CAST(count(*) AS bigint) FROM {mail_sql('category', 'email_type')} WHERE {_IN} AND category = 'other' GROUP BY 2",
    ]),
)
def _groups(spark, d):
    """Applications by status (all time), postings by page status and source, other messages by sort; most frequent first."""
    jobs = table(spark, d, "job").where(in_window("received_at"))
    other = newest_mail(spark, d, "category", "email_type", "received_at").where(in_window("received_at")).where("category = 'other'")
    parts = [(table(spark, d, "application"), "status", "application_status", "unknown"), (jobs, "scrape_status", "scrape_status", "unknown"),
             (jobs, "source", "source", "unknown"), (other, "email_type", "email_type", "unclassified")]
    counted = [
        rows.groupBy(F.coalesce(F.nullif(c, F.lit("")), F.lit(blank)).alias("label")).agg(F.count("*").alias("n")).select(F.lit(name).alias("grouping_"), "label", "n")
        for rows, c, name, blank in parts
    ]
    return _union(counted).orderBy("grouping_", F.desc("n"), "label")


@query("top_jobs", f"SELECT id, title, score FROM job WHERE matched AND {_IN} ORDER BY score DESC, id LIMIT 10")
def _top_jobs(spark, d):
    """The ten best postings of a window: a top-k report."""
    return table(spark, d, "job").where(in_window("received_at") & F.col("matched")).orderBy(F.desc("score"), "id").limit(10).select("id", "title", "score")


# -- funnel and brief ------------------------------------------------------------
_TOUCHED = f"(({_WIN.format(c='applied_at')}) OR ({_WIN.format(c='last_event_at')}))"
_STAGE_ROWS = " UNION ALL ".join(f"SELECT {i} AS position, {quoted(s)} AS status, {str(s in EXITS).lower()} AS is_exit" for i, s in enumerate((*STAGES, *EXITS)))


def _touched(spark, d) -> DataFrame:
    """Applications opened or moved in the window."""
    return table(spark, d, "application").where(in_window("applied_at") | in_window("last_event_at"))


@query(
    "funnel_stages",
    f"""SELECT k.status, k.position, k.is_exit, CAST(coalesce(c.n, 0) AS bigint) AS n FROM ({_STAGE_ROWS}) k
    LEFT JOIN (SELECT status, count(*) AS n FROM application WHERE {_TOUCHED} GROUP BY 1) c ON k.status = c.status""",
)
def _funnel_stages(spark, d):
    """Applications by stage and exit, zero filled."""
    filled = reports.zero_filled(_touched(spark, d), "status", [*STAGES, *EXITS]).where(F.col("position") < len(STAGES) + len(EXITS))
    return filled.select(F.col("label").alias("status"), "position", (F.col("position") >= len(STAGES)).alias("is_exit"), "n")


_PEAK = ", ".join(f"count(*) FILTER (WHERE status = {quoted(s)})" for s in (*STAGES, *EXITS))


@query(
    "funnel_summary",
    f"""SELECT CAST(count(*) AS bigint) AS total, round(count(*) FILTER (WHERE status IN ('interview', 'offer')) / greatest(1, count(*)), 6) AS interview_rate,
    round(count(*) FILTER (WHERE status = 'offer') / greatest(1, count(*)), 6) AS offer_rate, CAST(greatest(1, {_PEAK}) AS bigint) AS peak FROM application
    WHERE {_TOUCHED} AND (lower(company) LIKE '%group%' OR lower(role) LIKE '%group%' OR lower(status) LIKE '%group%')""",
)
def _funnel_summary(spark, d):
    """Rates and the highest stage of the applications that a search finds."""
    rows = reports.search(_touched(spark, d), "Group", "company", "role", "status")
    n, at = F.count("*"), lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        n.alias("total"), F.round((at("interview") + at("offer")) / F.greatest(F.lit(1), n), 6).alias("interview_rate"),
        F.round(at("offer") / F.greatest(F.lit(1), n), 6).alias("offer_rate"), F.greatest(F.lit(1), *map(at, (*STAGES, *EXITS))).alias("peak"),
    )


_STALE = f"NOT closed AND last_event_at < TIMESTAMPTZ '{NOW.isoformat()}' - INTERVAL 14 DAY AND trim(coalesce(role, '')) <> ''"


@query(
    "daily_brief",
    _union_sql([
        f"SELECT 'new_match' AS list, id FROM job WHERE matched AND duplicate_of IS NULL AND {_IN} ORDER BY score DESC, id LIMIT 8",
        f"SELECT 'follow_up', id FROM outreach WHERE {_FOLLOW} ORDER BY received_at DESC, id LIMIT 8",
        f"SELECT 'saved', id FROM job WHERE status = 'saved' AND {_IN} ORDER BY score DESC, id LIMIT 8",
        f"SELECT 'stale', id FROM application WHERE {_STALE} ORDER BY last_event_at, id LIMIT 8",
    ]),
)
def _brief(spark, d):
    """Eight of each: new matches, open follow-ups (of any time), saved postings, quiet applications."""
    jobs = table(spark, d, "job").where(in_window("received_at"))
    quiet = (F.col("last_event_at") < F.lit(NOW) - F.expr("INTERVAL 14 DAYS")) & ~F.col("closed") & (F.trim(F.coalesce("role", F.lit(""))) != "")
    lists = {
        "new_match": jobs.where("matched AND duplicate_of IS NULL").orderBy(F.desc("score"), "id"),
        "follow_up": table(spark, d, "outreach").where(_open_follow_up()).orderBy(F.desc("received_at"), "id"),
        "saved": jobs.where("status = 'saved'").orderBy(F.desc("score"), "id"),
        "stale": table(spark, d, "application").where(quiet).orderBy("last_event_at", "id"),
    }
    return _union([rows.limit(8).select(F.lit(name).alias("list"), "id") for name, rows in lists.items()])


# -- lists -----------------------------------------------------------------------
@query("mail_list", f"SELECT id, CAST(epoch(received_at) AS bigint) AS received_s FROM {mail_sql('received_at')}")
def _mail_list(spark, d):
    """Every message, newest first, without a cap."""
    mails = newest_mail(spark, d, "received_at")
    return mails.orderBy(F.desc("received_at"), "id").select("id", F.unix_seconds("received_at").alias("received_s"))


@query("recent_mail", f"SELECT id FROM {mail_sql('received_at')} WHERE received_at >= TIMESTAMPTZ '{NOW.isoformat()}' - INTERVAL 30 DAY")
def _recent(spark, d):
    """Messages of the last 30 days before a given instant."""
    start, _ = times.window_bounds(30, NOW)
    return newest_mail(spark, d, "received_at").where(F.col("received_at") >= F.lit(start)).select("id")


@query("mail_jobs", "SELECT message_id, id, row_number() OVER (PARTITION BY message_id ORDER BY coalesce(score, 0) DESC, id) AS place FROM job")
def _mail_jobs(spark, d):
    """The postings of each message, best first."""
    w = Window.partitionBy("message_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "id")
    return table(spark, d, "job").select("message_id", "id", F.row_number().over(w).cast("bigint").alias("place"))


@query("flags", f"SELECT id, flagged_category FROM {mail_sql('flagged_category', 'flagged_at')} WHERE flagged_category <> '' ORDER BY flagged_at DESC, id LIMIT 200")
def _flags(spark, d):
    """The 200 messages flagged last: a top-k report."""
    mails = newest_mail(spark, d, "flagged_category", "flagged_at").where("flagged_category <> ''")
    return mails.orderBy(F.desc("flagged_at"), "id").limit(200).select("id", "flagged_category")


@query("api_jobs", "SELECT id, url_key, score FROM job WHERE status = 'new' ORDER BY score DESC, id LIMIT 100")
def _api_jobs(spark, d):
    """The 100 best new postings: a top-k report."""
    return facets.matches(table(spark, d, "job").select("id", "url_key", "score", "status", "received_at"), status="new", sort="best", limit=100).select("id", "url_key", "score")


@query("matches_all", "SELECT id, score FROM job ORDER BY received_at DESC, score DESC, id LIMIT 300")
def _matches_all(spark, d):
    """``show=all`` sets status and threshold aside: the 300 newest postings, a top-k report."""
    return facets.matches(table(spark, d, "job"), status="saved", least=0.9, show="all", sort="no such order").select("id", "score")


@query("matches_worst", "SELECT id, score FROM job WHERE status = 'new' AND score >= 0.2 AND duplicate_of IS NULL ORDER BY score, received_at DESC, id LIMIT 300")
def _matches_worst(spark, d):
    """The 300 worst new postings above a threshold: a top-k report."""
    return facets.matches(table(spark, d, "job"), status="new", least=0.2, duplicates=False, sort="score_asc").select("id", "score")


@query(
    "people_follow_ups",
    f"""SELECT id, person_email FROM (SELECT * FROM outreach WHERE received_at >= TIMESTAMPTZ '{NOW.isoformat()}' - INTERVAL 365 DAY ORDER BY received_at DESC, id LIMIT 300)
    WHERE NOT regexp_matches(coalesce(person_email, ''), {quoted(fixed.NOREPLY)})""",
)
def _people(spark, d):
    """Of the 300 newest letters of a year (a top-k report) those that a person sent."""
    start, _ = times.window_bounds(365, NOW)
    newest = table(spark, d, "outreach").where(F.col("received_at") >= F.lit(start)).orderBy(F.desc("received_at"), "id").limit(300)
    return newest.where(~F.coalesce("person_email", F.lit("")).rlike(fixed.NOREPLY)).select("id", "person_email")


@query(
    "api_stats",
    _union_sql([
        "SELECT 'messages' AS metric, CAST(count(DISTINCT id) AS bigint) AS n FROM message", "SELECT 'jobs', CAST(count(*) AS bigint) FROM job",
        "SELECT 'jobs_new', CAST(count(*) AS bigint) FROM job WHERE status = 'new'",
        f"SELECT 'outreach_open', CAST(count(*) AS bigint) FROM outreach WHERE {_FOLLOW}",
    ]),
)
def _stats(spark, d):
    return _union([
        reports.metrics(table(spark, d, "message"), messages=F.countDistinct("id")),
        reports.metrics(table(spark, d, "job"), jobs=F.count("*"), jobs_new=F.count_if(F.col("status") == "new")),
        reports.metrics(table(spark, d, "outreach"), outreach_open=F.count_if(_open_follow_up())),
    ])


@query(
    "nav_counts",
    _union_sql([
        f"SELECT 'pending' AS metric, CAST(count(*) AS bigint) AS n FROM outreach WHERE {_FOLLOW}",
        f"SELECT 'flags', CAST(count(*) FILTER (WHERE flagged_category <> '') AS bigint) FROM {mail_sql('flagged_category')}",
        "SELECT 'errors', CAST(count(*) AS bigint) FROM scraped_job WHERE status = 'error' AND fetched_at >= (SELECT max(fetched_at) FROM scraped_job) - INTERVAL 24 HOUR",
        "SELECT 'mail', CAST(count(DISTINCT id) AS bigint) FROM message",
    ]),
)
def _nav(spark, d):
    pages = table(spark, d, "scraped_job").select("status", "fetched_at")
    last = pages.agg(F.max("fetched_at").alias("last")).scalar()
    fresh = pages.where(F.col("fetched_at") >= last - F.expr("INTERVAL 24 HOURS"))
    mails = newest_mail(spark, d, "flagged_category")
    return _union([
        reports.metrics(table(spark, d, "outreach"), pending=F.count_if(_open_follow_up())),
        reports.metrics(mails, flags=F.count_if(F.col("flagged_category") != ""), mail=F.count("*")),
        reports.metrics(fresh, errors=F.count_if(F.col("status") == "error")),
    ])


@query(
    "mail_page_counts",
    f"""WITH m AS (SELECT m.*, j.message_id IS NOT NULL AS stored FROM {mail_sql('category', 'jobs_found')} m LEFT JOIN (SELECT DISTINCT message_id FROM job) j ON m.id = j.message_id)
    SELECT 'empty_alerts' AS metric, CAST(count(*) FILTER (WHERE category = 'job_alert' AND coalesce(jobs_found, 0) = 0) AS bigint) AS n FROM m
    UNION ALL SELECT 'unstored', CAST(count(*) FILTER (WHERE coalesce(jobs_found, 0) > 0 AND NOT stored) AS bigint) FROM m""",
)
def _mail_page(spark, d):
    """Alerts without postings, and messages whose postings weren't stored."""
    mails = newest_mail(spark, d, "category", "jobs_found").withColumn("found", F.coalesce("jobs_found", F.lit(0)))
    stored = table(spark, d, "job").select(F.col("message_id").alias("id"))
    return _union([
        reports.metrics(mails, empty_alerts=F.count_if((F.col("category") == "job_alert") & (F.col("found") == 0))),
        reports.metrics(mails.where("found > 0").join(stored, "id", "left_anti"), unstored=F.count("*")),
    ])


_DAY = "strftime(timezone('America/New_York', received_at), '%A, %b %d')"


@query(
    "match_day_runs",
    f"""SELECT id, {_DAY} AS day, CAST(sum(new) OVER (ORDER BY score DESC, received_at DESC, id ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM (SELECT *,
    CASE WHEN {_DAY} IS NOT DISTINCT FROM lag({_DAY}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
    FROM (SELECT id, score, received_at FROM job ORDER BY score DESC, received_at DESC, id LIMIT 300) WINDOW w AS (ORDER BY score DESC, received_at DESC, id))""",
)
def _match_day_runs(spark, d):
    """The 300 best postings (a top-k report) in runs of one local day, in the order of the list."""
    best = facets.matches(table(spark, d, "job").select("id", "score", "received_at"), sort="score", show="all")
    day = times.day_label(F.col("received_at"))
    runs = reports.run_groups(best, day, [F.desc("score"), F.desc("received_at"), F.asc("id")])
    return runs.select("id", day.alias("day"), "run")


# -- runs and issues -------------------------------------------------------------
_RUNS = f"""SELECT CAST(floor(epoch(processed_at) / 900) * 900 AS bigint) AS started, count(*) AS fetched, coalesce(sum(jobs_found), 0) AS jobs_found,
    coalesce(sum(jobs_matched), 0) AS jobs_matched, count(*) FILTER (WHERE coalesce(body_text, '') = '') AS errors
    FROM (SELECT DISTINCT id, processed_at, jobs_found, jobs_matched, body_text FROM message) GROUP BY 1 ORDER BY 1 DESC LIMIT 96"""


def _runs(spark, d) -> DataFrame:
    """Ingest windows of 15 minutes with their sums; the 96 latest, a top-k report."""
    rows = table(spark, d, "message").select(
        "id", "processed_at", "jobs_found", "jobs_matched", (F.coalesce("body_text", F.lit("")) == "").alias("bad"), F.xxhash64("body_text").alias("digest")
    ).distinct()
    slot = (F.floor(F.unix_seconds("processed_at") / 900) * 900).cast("bigint").alias("started")
    return rows.groupBy(slot).agg(
        F.count("*").alias("fetched"), F.coalesce(F.sum("jobs_found"), F.lit(0)).alias("jobs_found"),
        F.coalesce(F.sum("jobs_matched"), F.lit(0)).alias("jobs_matched"), F.count_if("bad").alias("errors"),
    ).orderBy(F.desc("started")).limit(96)


@query(
    "poll_days",
    f"""SELECT strftime(timezone('America/New_York', to_timestamp(started)), '%A, %b %d') AS day, CAST(count(*) AS bigint) AS runs, CAST(sum(fetched) AS bigint) AS fetched,
    CAST(sum(jobs_found) AS bigint) AS jobs_found, CAST(sum(jobs_matched) AS bigint) AS jobs_matched, CAST(sum(errors) AS bigint) AS errors FROM ({_RUNS}) GROUP BY 1""",
)
def _poll_days(spark, d):
    """The latest runs by local day."""
    day = times.day_label(F.timestamp_seconds("started")).alias("day")
    sums = [F.sum(c).alias(c) for c in ("fetched", "jobs_found", "jobs_matched", "errors")]
    return _runs(spark, d).groupBy(day).agg(F.count("*").alias("runs"), *sums)


@query("poll_bars", f"SELECT CAST(greatest(1, coalesce(max(fetched), 1)) AS bigint) AS max_fetched, CAST(greatest(1, coalesce(max(jobs_found), 1)) AS bigint) AS max_jobs FROM ({_RUNS})")
def _poll_bars(spark, d):
    most = lambda c: F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(1)))
    return _runs(spark, d).agg(most("fetched").alias("max_fetched"), most("jobs_found").alias("max_jobs"))


_ISSUES = "SELECT DISTINCT split_part(url_key, ':', 1) AS source, status AS severity, fetched_at, url_key FROM scraped_job WHERE status IN ('error', 'blocked')"


def _issues(spark, d) -> DataFrame:
    """Failed page reads as a log of issues: source, severity, fetched_at, url_key."""
    rows = table(spark, d, "scraped_job").where(F.col("status").isin("error", "blocked"))
    return rows.select(F.substring_index("url_key", ":", 1).alias("source"), F.col("status").alias("severity"), "fetched_at", "url_key").distinct()


@query(
    "issue_counts",
    f"""SELECT source, severity, CAST(count(*) AS bigint) AS n FROM ({_ISSUES}) GROUP BY GROUPING SETS ((source), (severity), ())""",
)
def _issue_counts(spark, d):
    """Issues in total, by severity and by source."""
    rolled = reports.rollup(_issues(spark, d), "source", "severity")
    return rolled.where("level > 0").select("source", "severity", "n")


@query(
    "latest_issues",
    f"SELECT source, arg_max(url_key, {{'a': fetched_at, 'b': url_key}}) AS url_key FROM (SELECT * FROM ({_ISSUES}) ORDER BY fetched_at DESC, url_key LIMIT 80) GROUP BY source",
)
def _latest_issues(spark, d):
    """The latest issue of each source among the newest 80: a top-k report."""
    newest = _issues(spark, d).orderBy(F.desc("fetched_at"), "url_key").limit(80)
    return newest.groupBy("source").agg(F.max_by("url_key", F.struct("fetched_at", "url_key")).alias("url_key"))


@query("kept_issues", f"SELECT url_key FROM (SELECT * FROM ({_ISSUES}) ORDER BY fetched_at DESC, url_key DESC LIMIT 400)")
def _kept_issues(spark, d):
    """Retention: the newest 400 issues stay."""
    from missive.sources import sinks

    return sinks.newest(_issues(spark, d), "fetched_at", "url_key", 400).select("url_key")


# -- joins of postings, pages, mails and applications ----------------------------
@query(
    "job_with_mail",
    f"SELECT j.id, m.subject, m.category FROM job j LEFT JOIN {mail_sql('subject', 'category')} m ON j.message_id = m.id",
)
def _job_with_mail(spark, d):
    parents = newest_mail(spark, d, "subject", "category").withColumnRenamed("id", "message_id")
    return table(spark, d, "job").select("id", "message_id").join(parents, "message_id", "left").select("id", "subject", "category")


@query("outreach_with_mail", f"SELECT o.id, m.sender_email, m.category FROM outreach o LEFT JOIN {mail_sql('sender_email', 'category')} m ON o.message_id = m.id")
def _outreach_with_mail(spark, d):
    parents = newest_mail(spark, d, "sender_email", "category").withColumnRenamed("id", "message_id")
    return table(spark, d, "outreach").select("id", "message_id").join(parents, "message_id", "left").select("id", "sender_email", "category")


@query(
    "job_with_page",
    """SELECT j.id, coalesce(p.status, 'skipped') AS status, coalesce(nullif(p.salary, ''), nullif(j.salary, ''), '') AS salary FROM job j
    LEFT JOIN (SELECT url_key, min(status) AS status, min(salary) AS salary FROM scraped_job GROUP BY 1) p ON j.url_key = p.url_key""",
)
def _job_with_page(spark, d):
    """Postings with what their page gave, ``skipped`` without one; the page's salary counts first."""
    pages = table(spark, d, "scraped_job").groupBy("url_key").agg(F.min("status").alias("status"), F.min("salary").alias("page_salary"))
    joined = table(spark, d, "job").select("id", "url_key", "salary").join(pages, "url_key", "left")
    filled = F.coalesce(F.nullif("page_salary", F.lit("")), F.nullif("salary", F.lit("")), F.lit(""))
    return joined.select("id", F.coalesce("status", F.lit("skipped")).alias("status"), filled.alias("salary"))


def mail_candidates(spark, d) -> DataFrame:
    """Candidates of each message from its stored JSON: id, pos, title, company, url_key."""
    rows = newest_mail(spark, d, "extract_json")
    listed = F.from_json("extract_json", "array<struct<title string, company string, url_key string>>")
    return rows.select("id", F.posexplode(listed).alias("pos", "c")).select("id", F.col("pos").cast("bigint").alias("pos"), "c.*")


_CANDIDATES = f"""SELECT id, CAST(unnest(generate_series(0, len(cs) - 1)) AS bigint) AS pos, unnest(cs) AS c
    FROM (SELECT id, from_json(extract_json, '[{{"title": "VARCHAR", "company": "VARCHAR", "url_key": "VARCHAR"}}]') AS cs FROM {mail_sql('extract_json')} WHERE extract_json LIKE '[%')"""


@query("mail_candidates", f"SELECT id, pos, c.title AS title, c.company AS company, c.url_key AS url_key FROM ({_CANDIDATES})")
def _mail_candidates(spark, d):
    return mail_candidates(spark, d)


@query(
    "candidate_known",
    f"SELECT c.id, c.pos, min(j.id) AS job_id FROM (SELECT id, pos, c.url_key AS url_key FROM ({_CANDIDATES})) c JOIN job j ON c.url_key = j.url_key GROUP BY 1, 2",
)
def _candidate_known(spark, d):
    """Candidates whose posting is stored already."""
    known = table(spark, d, "job").select("url_key", F.col("id").alias("job_id"))
    return mail_candidates(spark, d).join(known, "url_key").groupBy("id", "pos").agg(F.min("job_id").alias("job_id"))


@query(
    "unstored_candidates",
    f"""SELECT m.category, CAST(count(*) AS bigint) AS n FROM {mail_sql('category', 'extract_json')} m WHERE extract_json LIKE '[%' AND length(extract_json) > 2
    AND NOT EXISTS (SELECT 1 FROM job j WHERE j.message_id = m.id AND j.matched) GROUP BY 1""",
)
def _unstored_candidates(spark, d):
    """Messages with candidates but no stored posting that matched, by category."""
    stored = table(spark, d, "job").where("matched").select(F.col("message_id").alias("id"))
    mails = newest_mail(spark, d, "category", "extract_json").where("extract_json LIKE '[%' AND length(extract_json) > 2")
    return mails.join(stored, "id", "left_anti").groupBy("category").agg(F.count("*").alias("n"))


@query(
    "application_job",
    """SELECT a.id, j.job_id FROM application a LEFT JOIN (SELECT dupe_key, arg_max(id, {'a': received_at, 'b': id}) AS job_id FROM job WHERE dupe_key <> '' GROUP BY 1) j
    ON a.match_key = j.dupe_key""",
)
def _application_job(spark, d):
    """The newest posting of each application's company and role."""
    newest = table(spark, d, "job").where("dupe_key <> ''").groupBy("dupe_key").agg(F.max_by("id", F.struct("received_at", "id")).alias("job_id"))
    apps = table(spark, d, "application").select("id", F.col("match_key").alias("dupe_key"))
    return apps.join(newest, "dupe_key", "left").select("id", "job_id")


# -- misses ----------------------------------------------------------------------
_THIN = "scrape_status IN ('empty', 'blocked', 'error') OR length(coalesce(description, '')) < 80"
_TAGGED = f"""
    SELECT m.id, array_to_string(list_filter([CASE WHEN length(trim(coalesce(body_text, ''))) < 40 THEN 'empty_body' END, CASE WHEN titled = 0 THEN 'zero_candidates' END,
        CASE WHEN titled > 0 AND stored = 0 THEN 'parsed_not_stored' END, CASE WHEN coalesce(jobs_found, 0) >= titled + 2 THEN 'title_count_gap' END,
        CASE WHEN thin > 0 THEN 'thin_scrape' END, CASE WHEN coalesce(flagged_category, '') <> '' THEN 'wrong_category' END], lambda x: x IS NOT NULL), ',') AS tags,
        titled, stored, coalesce(jobs_found, 0) AS expected
    FROM (SELECT m.*, coalesce(c.titled, 0) AS titled, coalesce(j.stored, 0) AS stored, coalesce(j.thin, 0) AS thin FROM {mail_sql('body_text', 'jobs_found', 'flagged_category')} m
        LEFT JOIN (SELECT id, count(*) AS titled FROM ({_CANDIDATES}) WHERE trim(coalesce(c.title, '')) <> '' GROUP BY 1) c ON m.id = c.id
        LEFT JOIN (SELECT message_id, count(*) AS stored, count(*) FILTER (WHERE {_THIN}) AS thin FROM job GROUP BY 1) j ON m.id = j.message_id) m"""


@query(
    "miss_report",
    f"""SELECT id, tags, CASE WHEN tags LIKE '%parsed_not_stored%' THEN 'parsed ' || titled || ' titled posting(s), stored 0'
    WHEN tags LIKE '%title_count_gap%' THEN 'expected about ' || expected || ' postings, extractor claimed ' || titled
    WHEN tags LIKE '%thin_scrape%' THEN 'job rows exist but descriptions look empty or blocked' WHEN tags LIKE '%empty_body%' THEN 'email body is nearly empty'
    WHEN tags LIKE '%zero_candidates%' THEN 'extractor found no postings' WHEN tags LIKE '%wrong_category%' THEN 'wrong category'
    ELSE 'parsed ' || titled || ', stored ' || stored END AS summary FROM ({_TAGGED})""",
)
def _miss_report(spark, d):
    """What seems to be amiss with each message's extraction, as tags and in words."""
    text = lambda c: F.coalesce(c, F.lit(""))
    titled = mail_candidates(spark, d).where(F.trim(text("title")) != "").groupBy("id").agg(F.count("*").alias("titled"))
    thin = F.col("scrape_status").isin("empty", "blocked", "error") | (F.length(text("description")) < 80)
    stored = table(spark, d, "job").groupBy(F.col("message_id").alias("id")).agg(F.count("*").alias("stored"), F.count_if(thin).alias("thin"))
    mails = newest_mail(spark, d, "body_text", "jobs_found", "flagged_category").select(
        "id", (F.length(F.trim(text("body_text"))) < 40).alias("bare"), text("flagged_category").alias("flag"), F.coalesce("jobs_found", F.lit(0)).alias("expected")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = mails.join(titled, "id", "left").join(stored, "id", "left").select("id", "bare", "flag", "expected", zero("titled"), zero("stored"), zero("thin"))
    return rows.select("id", *facets.miss_columns(F.col("bare"), F.col("flag") != "", F.col("expected"), F.col("titled"), F.col("stored"), F.col("thin")))


# -- logs ------------------------------------------------------------------------
@query(
    "events_once",
    """SELECT id, application_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY application_id, CASE WHEN coalesce(message_id, '') <> '' THEN message_id ELSE 'id ' || id END
    ORDER BY occurred_at DESC, id DESC) AS r FROM (SELECT DISTINCT id, application_id, kind, message_id, occurred_at FROM application_event)) WHERE r = 1""",
)
def _events_once(spark, d):
    """One event per application and message, however often it was recorded."""
    from missive.sources import store

    events = table(spark, d, "application_event").select("id", "application_id", "kind", "message_id", "occurred_at")
    return store.once(events, "application_id", "message_id", ["occurred_at", "id"]).select("id", "application_id", "kind")


@query(
    "flagged_update",
    f"""SELECT m.id, CASE WHEN coalesce(f.flagged_category, '') <> '' THEN f.flagged_category ELSE m.category END AS category FROM {mail_sql('category')} m
    LEFT JOIN (SELECT id, flagged_category FROM (SELECT id, flagged_category, row_number() OVER (PARTITION BY id ORDER BY flagged_at DESC, flagged_category DESC) AS r
      FROM message WHERE flagged_category <> '' AND flagged_at IS NOT NULL) WHERE r = 1) f ON m.id = f.id""",
)
def _flagged_update(spark, d):
    """Categories after the users' flags, which come as a log of actions."""
    from missive.sources import store

    flags = table(spark, d, "message").where("flagged_category <> '' AND flagged_at IS NOT NULL")
    actions = flags.select(F.lit("message").alias("table"), "id", F.lit("category").alias("field"), F.col("flagged_category").alias("value"), F.col("flagged_at").alias("at"))
    return store.acted(newest_mail(spark, d, "category"), actions, "message", "id", ["category"]).select("id", "category")


@query(
    "latest_state",
    "SELECT kind AS key, CAST(arg_max(id, {'a': occurred_at, 'b': id}) AS varchar) AS value FROM (SELECT DISTINCT kind, id, occurred_at FROM application_event) GROUP BY 1",
)
def _latest_state(spark, d):
    """A key-value log folded to its current values."""
    from missive.sources import store

    log = table(spark, d, "application_event").select(F.col("kind").alias("key"), F.col("occurred_at").alias("at"), "id")
    return store.newest(log, ["key"], "at").select("key", F.col("id").cast("string").alias("value"))
