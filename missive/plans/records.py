"""Queries of classification, fields, URLs, pages, boards and attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive import fixed
from missive.functions import boards, fields, html, pages, urls
from missive.functions import text as T
from missive.operators import classify, dedup, extract, fold
from missive.plans.base import in_list, query, quoted
from missive.plans.lists import FOLLOW_UPS, mail_sql, newest_mail
from missive.plans.registry import _norm_sql
from missive.runtime import table


def _hit(pattern: str, column: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


# -- classification --------------------------------------------------------------
_TEXTS = f"""SELECT id, coalesce(subject, '') AS s, coalesce(subject, '') || chr(10) || substr(coalesce(body_text, ''), 1, {fixed.RULE_TEXT}) AS b,
    coalesce(subject, '') || chr(10) || substr(coalesce(body_text, ''), 1, {fixed.FIELD_TEXT}) AS f,
    coalesce(jobs_found, 0) AS n, lower(coalesce(sender_email, '')) AS a FROM {mail_sql('subject', 'body_text', 'jobs_found', 'sender_email')}"""
_CLASSIFIED = f"""
    WITH flagged AS (SELECT *, {_hit(fixed.LOGIN_CODE, 'b')} OR {_hit(fixed.SECURITY, 'b')} AS code, {_hit(fixed.SUBMITTED, 'b')} OR {_hit(fixed.APPLIED, 'b')} AS receipt,
        {_hit(fixed.INTERVIEW, 'b')} AS interview, {_hit(fixed.ASSESSMENT, 'b')} AS assessment, {_hit(fixed.VIDEO_STEP, 'b')} AS video, {_hit(fixed.NEXT_STEP, 'b')} AS step,
        {_hit(fixed.ALERT_SUBJECT, 's')} AS alert, a = 'alerts@postbranch.example' OR split_part(a, '@', 2) IN ({in_list(fixed.JOB_HOSTS)}) AS board FROM ({_TEXTS})),
    ruled AS (SELECT *, CASE WHEN board AND alert THEN 'job_alert|0.95|job board sender + alert subject' WHEN {_hit(fixed.OFFER, 'b')} THEN 'offer|0.9|offer language'
        WHEN {_hit(fixed.REJECTION, 'b')} THEN 'rejection|0.85|rejection language' WHEN video THEN 'next_step|0.85|recorded video round'
        WHEN interview THEN 'interview_invite|0.85|interview scheduling language' WHEN assessment THEN 'assessment|0.85|assessment language'
        WHEN step THEN 'next_step|0.8|asks you to complete a step' WHEN receipt THEN 'application_update|0.8|application acknowledgement'
        WHEN board AND n >= 2 THEN 'job_alert|0.9|job board sender + posting links' WHEN n >= 2 THEN 'job_alert|0.85|' || n || ' posting links extracted'
        WHEN n >= 1 AND alert THEN 'job_alert|0.75|alert subject with posting link'
        WHEN {_hit(fixed.RECRUITER, 'b')} THEN 'recruiter_outreach|' || CASE WHEN {_hit(fixed.NOREPLY, 'a')} THEN '0.6' ELSE '0.85' END || '|recruiter outreach language'
        WHEN {_hit(fixed.MARKETING, 'b')} THEN 'other|0.7|marketing/transactional' ELSE 'other|0.3|no rule matched' END AS rule FROM flagged),
    decided AS (SELECT *, CASE WHEN code THEN 'other|0.95|login/security code' WHEN receipt AND NOT (interview OR assessment OR video OR step) AND rule NOT LIKE 'application_update%'
        THEN 'application_update|0.85|application acknowledgement' ELSE rule END AS d FROM ruled)
    SELECT id, split_part(d, '|', 1) AS category, CAST(split_part(d, '|', 2) AS double) AS confidence, split_part(d, '|', 3) AS reason,
        CASE WHEN code THEN 'security' WHEN split_part(d, '|', 1) <> 'other' THEN '' WHEN {_hit(fixed.SECURITY, 'f')} OR {_hit(fixed.LOGIN_CODE, 'f')} THEN 'security'
        WHEN {_hit(fixed.WEBINAR, 'f')} THEN 'webinar' WHEN {_hit(fixed.NEWSLETTER, 'f')} THEN 'newsletter' ELSE 'unclassified' END AS email_type FROM decided"""


def _classified(spark, d) -> DataFrame:
    rows = table(spark, d, "message").select("id", "processed_at", "subject", "body_text", "jobs_found", "sender_email")
    told = classify.classified(rows, "subject", "body_text", "sender_email", F.col("jobs_found"), ("alerts@postbranch.example",))
    # All rows are classified before the newest of each message is taken, so that no text moves.
    order = [-F.unix_micros("processed_at"), F.col("subject"), F.xxhash64("body_text"), F.col("jobs_found"), F.col("sender_email")]
    narrow = told.withColumns({f"_o{i}": o for i, o in enumerate(order)}).drop("body_text", "subject", "processed_at")
    return dedup.best_per_key(narrow, ["id"], [F.col(f"_o{i}") for i in range(len(order))])


@query("classify_messages", _CLASSIFIED)
def _classify(spark, d):
    return _classified(spark, d).select("id", "category", "confidence", "reason", "email_type")


@query(
    "store_gate",
    f"""SELECT c.id, CASE WHEN coalesce(k.n, 0) = 0 THEN false WHEN category = 'job_alert' THEN true WHEN category = 'other' THEN titled > 0
    WHEN category = 'application_update' THEN linked > 0 ELSE false END AS stores FROM ({_CLASSIFIED}) c
    LEFT JOIN (SELECT message_id, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(title, '')) <> '') AS titled,
      count(*) FILTER (WHERE trim(coalesce(title, '')) <> '' AND (coalesce(source, '') <> '' OR coalesce(url, '') <> '')) AS linked FROM job GROUP BY 1) k ON c.id = k.message_id""",
)
def _store_gate(spark, d):
    """Whether the postings of a message are stored, by its category and their titles and links."""
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    titled = F.trim(F.coalesce("title", F.lit(""))) != ""
    found = table(spark, d, "job").groupBy(F.col("message_id").alias("id")).agg(
        F.count("*").alias("n"), F.count_if(titled).alias("titled"), F.count_if(titled & (text("source") | text("url"))).alias("linked")
    )
    rows = _classified(spark, d).select("id", "category").join(found, "id", "left")
    gate = (
        F.when(F.col("n").isNull(), False).when(F.col("category") == "job_alert", True).when(F.col("category") == "other", F.col("titled") > 0)
        .when(F.col("category") == "application_update", F.col("linked") > 0).otherwise(False)
    )
    return rows.select("id", gate.alias("stores"))


_BLOB = "coalesce(o.subject, '') || chr(10) || coalesce(o.summary, '') || chr(10) || coalesce(m.subject, '') || chr(10) || coalesce(m.body_text, '') || chr(10) || coalesce(m.snippet, '')"
_ASKS = " OR ".join(_hit(p, "b") for p in (fixed.INTERVIEW, fixed.ASSESSMENT, fixed.VIDEO_STEP, fixed.NEXT_STEP))


@query(
    "demoted_follow_ups",
    f"""SELECT id, CASE WHEN open_ AND ({_hit(fixed.LOGIN_CODE, 'b')} OR {_hit(fixed.SECURITY, 'b')}) THEN 'other'
    WHEN open_ AND ({_hit(fixed.SUBMITTED, 'b')} OR {_hit(fixed.APPLIED, 'b')}) AND NOT ({_ASKS}) THEN 'application_update' ELSE kind END AS kind
    FROM (SELECT o.id, o.kind, NOT o.handled AND o.kind IN ({in_list(FOLLOW_UPS)}) AS open_, {_BLOB} AS b FROM outreach o
      LEFT JOIN {mail_sql('subject', 'body_text', 'snippet')} m ON o.message_id = m.id)""",
)
def _demoted(spark, d):
    """Kinds of letters after codes and mere receipts are taken off the follow-ups."""
    mails = newest_mail(spark, d, "subject", "body_text", "snippet").toDF("message_id", "mail_subject", "body_text", "snippet")
    rows = table(spark, d, "outreach").join(mails, "message_id", "left")
    blob = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in ("subject", "summary", "mail_subject", "body_text", "snippet")))
    rows = rows.select("id", "kind", (~F.col("handled") & F.col("kind").isin(*FOLLOW_UPS)).alias("open"), blob.alias("b"))
    b = F.col("b")
    asks = b.rlike(fixed.INTERVIEW) | b.rlike(fixed.ASSESSMENT) | b.rlike(fixed.VIDEO_STEP) | b.rlike(fixed.NEXT_STEP)
    kind = (
        F.when(F.col("open") & (b.rlike(fixed.LOGIN_CODE) | b.rlike(fixed.SECURITY)), "other")
        .when(F.col("open") & (b.rlike(fixed.SUBMITTED) | b.rlike(fixed.APPLIED)) & ~asks, "application_update").otherwise(F.col("kind"))
    )
    return rows.select("id", kind.alias("kind"))


# -- fields ----------------------------------------------------------------------
_T = "coalesce(description, '')"
_SQUEEZED = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
_KIND = f"regexp_replace(lower(regexp_extract({{c}}, {quoted(fixed.EMPLOYMENT)}, 1)), '\\s+', ' ', 'g')"


def _employment_sql(c: str) -> str:
    kind = _KIND.format(c=c)
    return f"CASE {kind} WHEN '' THEN '' " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in fixed.EMPLOYMENT_LABELS.items()) + f" ELSE {kind} END"


def _visa_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hit(p, c)} THEN {quoted(label)}" for p, label, _ in fields.VISA_RULES) + " ELSE '' END"


def _clipped(pattern: str, c: str, group: int, most: int = 80) -> str:
    return f"substr({_SQUEEZED(f'regexp_extract({c}, {quoted(pattern)}, {group})')}, 1, {most})"


def _state_sql(place: str, text: str) -> str:
    return f"""CASE WHEN regexp_extract({place}, {quoted(fixed.STATE)}, 1) <> '' THEN regexp_extract({place}, {quoted(fixed.STATE)}, 1)
    WHEN {_hit(fixed.REMOTE, f"({place} || ' ' || substr({text}, 1, 1500))")} THEN 'Remote' ELSE regexp_extract(substr({text}, 1, 2000), {quoted(fixed.STATE)}, 1) END"""


def _skills_sql(c: str) -> str:
    one = lambda n: f"regexp_matches(lower({c}), '(^|[^a-z0-9]){n}([^a-z0-9]|$)')" if len(n) < 3 else f"contains(lower({c}), {quoted(n)})"
    names = ", ".join(f"CASE WHEN {one(n)} THEN {quoted(n)} END" for n in fixed.SKILLS)
    return f"array_to_string(list_slice(list_filter([{names}], lambda x: x IS NOT NULL), 1, 20), ', ')"


def _from_description(name: str, column: str, sql: str, make):
    @query(name, f"SELECT id, {sql} AS {column} FROM job")
    def run(spark, d):
        return table(spark, d, "job").select("id", make(F.col("description")).alias(column))

    return run


_from_description("employment_text", "employment_type", _employment_sql(_T), fields.employment)
_from_description("experience_text", "experience", _clipped(fixed.EXPERIENCE, _T, 1), fields.experience)
_from_description("salary_text", "salary", _clipped(fixed.SALARY, _T, 0), fields.salary)
_from_description("visa_text", "visa", _visa_sql(_T), fields.visa)
_from_description("skills_text", "skills", _skills_sql(_T), fields.skills)


@query("state_code", f"SELECT id, {_state_sql('''coalesce(location, '')''', _T)} AS state FROM job")
def _state(spark, d):
    return table(spark, d, "job").select("id", fields.state_of(F.col("location"), F.col("description")).alias("state"))


@query("email_types", f"""SELECT id, CASE WHEN category <> 'other' THEN '' WHEN {_hit(fixed.SECURITY, 'b')} OR {_hit(fixed.LOGIN_CODE, 'b')} THEN 'security'
    WHEN {_hit(fixed.WEBINAR, 'b')} THEN 'webinar' WHEN {_hit(fixed.NEWSLETTER, 'b')} THEN 'newsletter' ELSE 'unclassified' END AS email_type
    FROM (SELECT id, category, coalesce(subject, '') || chr(10) || coalesce(body_text, '') AS b FROM {mail_sql('category', 'subject', 'body_text')})""")
def _email_types(spark, d):
    mails = newest_mail(spark, d, "category", "subject", "body_text")
    return mails.select("id", fields.email_type(F.col("category"), F.col("subject"), F.col("body_text")).alias("email_type"))


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', '')"
_SOURCE_TYPE = f"""CASE WHEN lower(coalesce(source, '')) IN ({in_list(fixed.BOARD_SOURCES)}) THEN 'job_board'
    WHEN lower(coalesce(source, '')) IN ({in_list(fixed.OFFICIAL_SOURCES)}) OR regexp_matches({_HOST}, 'careers|jobs|workday') THEN 'official_career_site'
    WHEN coalesce(source, '') <> '' THEN 'job_board' ELSE '' END"""
_POSTING_ID = "CASE WHEN contains(coalesce(url_key, ''), ':') THEN substr(substr(url_key, instr(url_key, ':') + 1), 1, 120) ELSE coalesce(url_key, '') END"
_BLOB_TEXT = "(coalesce(location, '') || chr(10) || coalesce(description, ''))"
_OR = lambda column, told: f"CASE WHEN coalesce({column}, '') <> '' THEN {column} ELSE {told} END"
_VISA_NOTE = _SQUEEZED("coalesce(visa_sponsorship, '')")
_VISA_BLOB = f"(coalesce(visa_sponsorship, '') || chr(10) || {_BLOB_TEXT})"


@query(
    "enrich_fields",
    f"""SELECT id, {_OR('source_type', _SOURCE_TYPE)} AS source_type, {_OR('posting_id', _POSTING_ID)} AS posting_id,
    {_OR('state', _state_sql("coalesce(location, '')", _T))} AS state, {_OR('salary', _clipped(fixed.SALARY, _BLOB_TEXT, 0))} AS salary,
    {_OR('employment_type', _employment_sql(_BLOB_TEXT))} AS employment_type, {_OR('experience_required', _clipped(fixed.EXPERIENCE, _BLOB_TEXT, 1))} AS experience_required,
    {_OR('required_skills', _skills_sql(_BLOB_TEXT))} AS required_skills, {_OR('posted_at', f"regexp_extract({_T}, {quoted(T.DATE_ISO)}, 1)")} AS posted_at,
    CASE WHEN {_visa_sql(_VISA_BLOB)} <> '' THEN {_visa_sql(_VISA_BLOB)} WHEN {_VISA_NOTE} IN ({in_list(fixed.VISA_LABELS)}) THEN {_VISA_NOTE} ELSE '' END AS visa_sponsorship
    FROM job""",
)
def _enrich(spark, d):
    """The stored fields of postings, blanks filled from their texts."""
    job = table(spark, d, "job").withColumn("host", F.coalesce(urls.url_parts(F.col("url"))["host"], F.lit("")))
    given = {n: F.col(n) for n in fields.FIELDS}
    told = fields.enriched(given, F.col("source"), F.col("host"), F.col("url_key"), F.col("location"), F.col("description"))
    return job.select("id", *(c.alias(n) for n, c in told.items()))


@query("source_types", f"SELECT id, {_SOURCE_TYPE} AS source_type, {_POSTING_ID} AS posting_id FROM job")
def _source_types(spark, d):
    host = urls.url_parts(F.col("url"))["host"]
    return table(spark, d, "job").select("id", fields.source_type(F.col("source"), host).alias("source_type"), fields.posting_id(F.col("url_key")).alias("posting_id"))


# -- URLs ------------------------------------------------------------------------
_PATH = r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
_URL_KEY = f"({_HOST} || ':' || {_HOST} || rtrim({_PATH}, '/'))"


@query(
    "url_canonical",
    f"""SELECT id, url AS unwrapped, {_HOST} AS host, '' AS source, {_URL_KEY} AS key, substr(substr({_URL_KEY}, instr({_URL_KEY}, ':') + 1), 1, 120) AS posting_id,
    NOT {_hit(fixed.AWAY_PATH, _PATH)} AND {_hit(fixed.STRONG_POSTING_PATH, _PATH)} AS is_posting, false AS is_tracker FROM job""",
)
def _url_canonical(spark, d):
    """URLs of the tables are of no known board, so their host and path make the key."""
    return table(spark, d, "job").select("id", urls.url_parts(F.col("url")).alias("u")).select("id", "u.*")


_UUID = "5d1f3a90-77aa-4c1e-9b2d-0f60c1a2b3c4"
#: Hand-made URLs and what they are: URL, key, board, leads to a posting.
URL_CASES = [
    ("https://www.linkedin.com/comm/jobs/view/4455667788/?trk=eml", "linkedin:4455667788", "linkedin", True),
    ("https://linkedin.com/jobs/view/data-steward-at-zeta-4455667788", "linkedin:4455667788", "linkedin", True),
    ("https://www.linkedin.com/jobs/collections/?currentJobId=4455667788", "linkedin:4455667788", "linkedin", True),
    ("https://de.indeed.com/rc/clk?jk=0f1e2d3c4b5a6978&from=ja", "indeed:0f1e2d3c4b5a6978", "indeed", True),
    ("https://indeed.com/jobs?q=sql&vjk=0f1e2d3c4b5a6978", "indeed:0f1e2d3c4b5a6978", "indeed", True),
    ("https://zeta.example/open-roles?gh_jid=6600123", "greenhouse:6600123", "", True),
    ("https://boards.greenhouse.io/embed/job_app?for=zeta&token=6600123", "greenhouse:6600123", "greenhouse", True),
    ("https://job-boards.greenhouse.io/zeta/jobs/6600123", "greenhouse:6600123", "greenhouse", True),
    (f"https://jobs.lever.co/zeta/{_UUID}/apply", f"lever:zeta:{_UUID}", "lever", True),
    (f"https://jobs.ashbyhq.com/zeta/{_UUID}", f"ashby:zeta:{_UUID}", "ashby", True),
    ("https://zeta.wd3.myworkdayjobs.com/en/Site/job/Oslo/Engineer_JR-77/", "workday:zeta.wd3.myworkdayjobs.com:Oslo/Engineer_JR-77", "workday", True),
    ("https://jobs.smartrecruiters.com/Zeta/744000012-engineer", "smartrecruiters:Zeta:744000012-engineer", "smartrecruiters", False),
    ("https://apply.workable.com/zeta/j/1A2B3C4D5E/", "workable:zeta:1A2B3C4D5E", "workable", False),
    ("https://zeta.eightfold.ai/careers?pid=998877", "eightfold:zeta.eightfold.ai:998877", "eightfold", True),
    ("https://jobs.zeta.example/careers?pid=998877", "pid:jobs.zeta.example:998877", "", True),
    ("https://www.glassdoor.com/partner/jobListing.htm?jobListingId=1009", "glassdoor:1009", "glassdoor", True),
    ("https://www.glassdoor.com/x?guid=0abc&pos=102", "glassdoor:0abc:102", "glassdoor", True),
    ("https://www.adzuna.co.uk/land/ad/5544332211?se=x", "adzuna:5544332211", "adzuna", True),
    ("https://builtin.com/job/data-engineer/3344", "builtin:3344", "builtin", True),
    ("https://jobs.apple.com/en-us/details/200512345/ml-engineer", "apple:200512345", "apple", True),
    ("https://recruiting.ultipro.com/ZET1000/JobBoard/x/OpportunityDetail?opportunityId=12", "ultipro:recruiting.ultipro.com/ZET1000/JobBoard/x/OpportunityDetail:12", "ultipro", True),
    ("https://recruiting.ultipro.com/ZET1000/JobBoard/x/", "ultipro:recruiting.ultipro.com/ZET1000/JobBoard/x", "ultipro", False),
    ("https://zeta.jobs/oslo/data-engineer/job/Engineer/55443-en_US", "jobs2web:zeta.jobs/oslo/data-engineer/job/Engineer/55443-en_US", "jobs2web", True),
    ("https://www.linkedin.com/jobs/search/?keywords=sql", "linkedin:linkedin.com/jobs/search", "linkedin", False),
    ("https://www.linkedin.com/unsubscribe?id=5", "linkedin:linkedin.com/unsubscribe:5", "linkedin", False),
    ("https://zeta.co.uk/careers", "zeta.co.uk:zeta.co.uk/careers", "", False),
    ("https://zeta.co.uk/careers/role-4471", "zeta.co.uk:zeta.co.uk/careers/role-4471", "", True),
    ("https://go.zeta.example/t?m=3&target=https%3A%2F%2Fjobs.lever.co%2Fzeta%2F" + _UUID, f"lever:zeta:{_UUID}", "lever", True),
    ("https://t.zeta.example/l0/https:%2F%2Fbuiltin.com%2Fjob%2Fdata-engineer%2F3344/1/0102-aa", "builtin:3344", "builtin", True),
    ("https://app.eightfold.ai/vsimp?d=opaque&n=https%3A%2F%2Fjobs.zeta.example%2Fcareers%3Fpid%3D998877", "pid:jobs.zeta.example:998877", "", True),
    ("https://haystack.cv/go?j=k9&u=https%3A%2F%2Fx.example", "haystack:k9", "haystack", True),
    ("https://[zeta", "", "", False),
]


@query(
    "url_cases",
    "SELECT url, key, source, is_posting FROM (VALUES "
    + ", ".join(f"({quoted(u)}, {quoted(k)}, {quoted(s)}, {str(p).lower()})" for u, k, s, p in URL_CASES)
    + ") AS t(url, key, source, is_posting)",
)
def _url_cases(spark, d):
    """URLs of known boards and wrappers against their written keys."""
    given = spark.createDataFrame([(u,) for u, *_ in URL_CASES], "url string")
    return given.select("url", urls.url_parts(F.col("url")).alias("u")).select("url", "u.key", "u.source", "u.is_posting")


# -- pages and boards ------------------------------------------------------------
_SQUEEZE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def _flat(column: str):
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " "))


@query(
    "page_fields",
    f"""SELECT id, {_SQUEEZE('title')} AS title, {_SQUEEZE('company')} AS company, {_SQUEEZE('location')} AS location, {_SQUEEZE('description')} AS description,
    CASE WHEN regexp_matches(coalesce(posted_at, ''), '20\\d\\d-\\d\\d-\\d\\d') THEN regexp_extract(posted_at, '\\b20\\d\\d-\\d\\d-\\d\\d\\b', 0) ELSE substr(trim(coalesce(posted_at, '')), 1, 32) END AS posted_at,
    'EUR 40000–55000 /year' AS salary, 'Full-Time' AS employment_type, 'jsonld' AS extraction,
    CASE WHEN length({_SQUEEZE('description')}) > 40 THEN 'ok' ELSE 'empty' END AS status FROM job""",
)
def _page_fields(spark, d):
    """Pages that carry their posting as JSON-LD in a graph, read back."""
    posting = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.array(F.struct(F.lit("WebPage").alias("@type"), F.lit(None).cast("string").alias("title")).alias("x"),).alias("unused"),
        F.array(F.struct(
            F.lit("JobPosting").alias("@type"), _flat("title").alias("title"), F.struct(_flat("company").alias("name")).alias("hiringOrganization"),
            F.struct(F.struct(_flat("location").alias("addressLocality")).alias("address")).alias("jobLocation"),
            F.replace(F.replace(F.replace(_flat("description"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("description"),
            F.trim(F.coalesce("posted_at", F.lit(""))).alias("datePosted"), F.array(F.lit("FULL_TIME")).alias("employmentType"),
            F.struct(F.lit("EUR").alias("currency"), F.struct(F.lit(40000).alias("minValue"), F.lit(55000).alias("maxValue"), F.lit("YEAR").alias("unitText")).alias("value")).alias("baseSalary"),
        )).alias("@graph"),
    ))
    safe = F.replace(posting, F.lit("</"), F.lit("<\\/"))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), safe, F.lit("</script></head><body><nav>Home</nav></body></html>"))
    return table(spark, d, "job").select("id", html.page_fields(page).alias("p")).select("id", "p.*")


_BODY = f"substr({_SQUEEZE('description')}, 1, 20000)"
_STOPOVER = f"""({_hit(fixed.STOPOVER_PAGE, f"('Posting' || chr(10) || substr(body, 1, {fixed.STOPOVER_WITHIN}))")}
    OR ({_hit(fixed.MENU_PAGE, f'substr(body, 1, {fixed.MENU_WITHIN})')} AND NOT {_hit(fixed.POSTING_WORDS, 'body')}))"""
_BLOCKED = f"(length(body) < {fixed.BLOCKED_MOST} AND {_hit(fixed.BLOCKED_PAGE, f'substr(body, 1, {fixed.BLOCKED_WITHIN})')})"


@query(
    "page_status",
    f"""SELECT id, CASE WHEN {_STOPOVER} THEN '' ELSE 'Posting' END AS title, CASE WHEN {_STOPOVER} THEN '' ELSE body END AS description,
    CASE WHEN {_STOPOVER} THEN 'empty' WHEN {_BLOCKED} THEN 'blocked' WHEN body = '' OR {_hit(fixed.FORM_PAGE, f'substr(body, 1, {fixed.FORM_WITHIN})')} THEN 'empty' ELSE 'ok' END AS status
    FROM (SELECT id, {_BODY} AS body FROM job)""",
)
def _page_status(spark, d):
    """Pages with menus, heads, forms and feet around a text, read back without them and told apart from walls."""
    text = F.replace(F.replace(_flat("description"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit("<html><head><title>Home</title><meta property='og:title' content='Posting'></head><body><header><h2>Zeta</h2></header><nav><a href='/x'>Menu</a></nav>"
              "<form>Search</form><div class='job-details'><p>"), text, F.lit("</p></div><aside>See also</aside><footer>About</footer><script>x</script></body></html>"),
    )
    return table(spark, d, "job").select("id", html.page_fields(page).alias("p")).select("id", "p.title", "p.description", "p.status")


#: Keys and URLs, and where their boards give the posting as data.
TARGET_CASES = [
    ("linkedin:4455667788", "https://linkedin.com/jobs/view/4455667788", "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/4455667788", "linkedin"),
    ("greenhouse:66", "https://boards.greenhouse.io/embed/job_app?for=zeta&token=66", "https://boards-api.greenhouse.io/v1/boards/zeta/jobs/66", "greenhouse"),
    ("greenhouse:66", "https://job-boards.greenhouse.io/zeta/jobs/66?x=1", "https://boards-api.greenhouse.io/v1/boards/zeta/jobs/66", "greenhouse"),
    ("greenhouse:66", "https://zeta.example/roles?gh_jid=66", "https://zeta.example/roles?gh_jid=66", "html"),
    ("lever:zeta:ab-12", "https://jobs.lever.co/zeta/ab-12", "https://api.lever.co/v0/postings/zeta/ab-12?mode=json", "lever"),
    ("ashby:zeta:ab-12", "https://jobs.ashbyhq.com/zeta/ab-12", "https://api.ashbyhq.com/posting-api/job-board/zeta?includeCompensation=true", "ashby"),
    ("workday:zeta.wd3.myworkdayjobs.com:Oslo/E_77", "https://zeta.wd3.myworkdayjobs.com/en-US/Site/job/Oslo/E_77/", "https://zeta.wd3.myworkdayjobs.com/wday/cxs/zeta/Site/job/Oslo/E_77", "workday"),
    ("smartrecruiters:Zeta:744-e", "https://jobs.smartrecruiters.com/Zeta/744-e?a=b", "https://api.smartrecruiters.com/v1/companies/Zeta/postings/744-e", "smartrecruiters"),
    ("workable:zeta:1A2B", "https://apply.workable.com/zeta/j/1A2B/", "https://apply.workable.com/api/v2/accounts/zeta/jobs/1A2B", "workable"),
    ("indeed:0f1e", "https://indeed.com/rc/clk?jk=0f1e", "https://www.indeed.com/viewjob?jk=0f1e", "html"),
    ("zeta.example:zeta.example/a", "https://zeta.example/a", "https://zeta.example/a", "html"),
    ("", "", "", "html"),
]


@query(
    "api_targets",
    "SELECT url_key, url, target, parser FROM (VALUES " + ", ".join(f"({', '.join(map(quoted, c))})" for c in TARGET_CASES) + ") AS t(url_key, url, target, parser)",
)
def _api_targets(spark, d):
    """Keys and URLs of known boards against their written data addresses."""
    given = spark.createDataFrame([c[:2] for c in TARGET_CASES], "url_key string, url string")
    return given.select("url_key", "url", pages.api_target(F.col("url_key"), F.col("url")).alias("t")).select("url_key", "url", "t.*")


def _payloads() -> dict:
    """Each board's JSON of a posting's title, company, place and day."""
    c, as_ = F.col, lambda e, n: e.alias(n)
    deep = lambda e, *names: deep(F.struct(e.alias(names[-1])), *names[:-1]) if len(names) > 1 else e.alias(names[0])
    day = F.lit("2024-05-01T10:00:00Z")
    return {
        "greenhouse": F.struct(as_(c("title"), "title"), as_(c("company"), "company_name"), deep(c("location"), "location", "name"), as_(day, "updated_at")),
        "lever": F.struct(as_(c("title"), "text"), as_(c("company"), "company"), deep(c("location"), "categories", "location"), as_(F.lit(1714557600000), "createdAt")),
        "ashby": F.struct(as_(c("title"), "title"), as_(c("company"), "organizationName"), as_(c("location"), "locationName"), as_(day, "publishedDate")),
        "workday": F.struct(F.struct(as_(c("title"), "title"), as_(c("location"), "location"), as_(day, "startDate")).alias("jobPostingInfo"), deep(c("company"), "hiringOrganization", "name")),
        "smartrecruiters": F.struct(as_(c("title"), "name"), deep(c("company"), "company", "name"), deep(c("location"), "location", "city"), as_(day, "releasedDate")),
        "workable": F.struct(as_(c("title"), "title"), as_(c("company"), "company"), deep(c("location"), "location", "city"), as_(day, "published")),
    }


@query(
    "board_fields",
    """SELECT id, board, trim(coalesce(title, '')) AS title, trim(coalesce(company, '')) AS company, trim(coalesce(location, '')) AS location, '2024-05-01' AS posted_at
    FROM job, (SELECT unnest(['greenhouse', 'lever', 'ashby', 'workday', 'smartrecruiters', 'workable']) AS board)""",
)
def _board_fields(spark, d):
    """Postings packed as each board's JSON and read back: a round trip."""
    packed = F.array(*(F.struct(F.lit(n).alias("board"), F.to_json(p).alias("payload")) for n, p in _payloads().items()))
    rows = table(spark, d, "job").select("id", F.explode(packed).alias("p")).select("id", "p.*")
    rows = rows.select("id", "board", boards.board_fields(F.col("board"), F.col("payload")).alias("b"))
    return rows.select("id", "board", F.trim("b.title").alias("title"), F.trim("b.company").alias("company"), F.trim("b.location").alias("location"), "b.posted_at")


# -- attachment and throttling ---------------------------------------------------
_EVENTS = f"SELECT id AS event_id, {_norm_sql('company', fixed.COMPANY_NOISE)} AS ec, {_norm_sql('role', fixed.ROLE_NOISE)} AS er, coalesce(role, '') <> '' AS given FROM outreach"
_ENTITIES = f"SELECT id, {_norm_sql('company', fixed.COMPANY_NOISE)} AS tc, {_norm_sql('role', fixed.ROLE_NOISE)} AS tr, last_event_at AS t, closed FROM application"


@query(
    "attach_fuzzy",
    f"""WITH p AS (SELECT e.*, a.*, ec = tc AS same, er <> '' AND tr <> '' AND (contains(er, tr) OR contains(tr, er)) AS alike FROM ({_EVENTS}) e JOIN ({_ENTITIES}) a
      ON ec <> '' AND tc <> '' AND (ec = tc OR starts_with(ec, tc || ' ') OR starts_with(tc, ec || ' '))),
    q AS (SELECT *, bool_or(same) OVER (PARTITION BY event_id) AS own FROM p),
    r AS (SELECT *, CASE WHEN given AND same AND er = tr THEN 0 WHEN alike THEN 1 WHEN NOT closed THEN 2 ELSE 3 END AS tier FROM q WHERE same OR NOT own)
    SELECT event_id, id AS entity_id, tier, NOT own AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tier,
      CASE WHEN tier = 0 THEN 0 ELSE -epoch_us(t) END, id) AS n FROM r) WHERE n = 1""",
)
def _attach(spark, d):
    """Letters to tracked applications of their company and role."""
    events = table(spark, d, "outreach").select(
        F.col("id").alias("event_id"), T.normalise_company(F.col("company")).alias("company"), T.normalise_role(F.col("role")).alias("role"),
        (F.coalesce("role", F.lit("")) != "").alias("has_role"),
    )
    apps = table(spark, d, "application").select(
        F.col("id").alias("entity_id"), T.normalise_company(F.col("company")).alias("company"), T.normalise_role(F.col("role")).alias("role"), "last_event_at", "closed"
    )
    return fold.attach(events, apps)


@query(
    "throttle_10min",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
    k AS (SELECT user_id, event_type, min({'t': t, 'id': event_id}) AS s FROM e GROUP BY ALL
      UNION ALL SELECT k.user_id, k.event_type, min({'t': e.t, 'id': e.event_id}) FROM k JOIN e ON k.user_id = e.user_id AND k.event_type = e.event_type AND e.t >= k.s.t + 600000000 GROUP BY ALL)
    SELECT s.id AS event_id, user_id, event_type FROM k""",
)
def _throttle(spark, d):
    """Events at least ten minutes after the last kept one of their user and type."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return dedup.throttle(rows, ["user_id", "event_type"], "ts", 600, "event_id").select("event_id", "user_id", "event_type")


# -- digests ---------------------------------------------------------------------
def _digests(spark, d) -> DataFrame:
    """A digest mail made of each message's postings: cards in a table, behind a click tracker, with a foot."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.coalesce(F.nullif(_flat("title"), F.lit("")), F.lit("Data Engineer"))
    target = F.concat(F.lit("https%3A%2F%2Fwww.linkedin.com%2Fcomm%2Fjobs%2Fview%2F"), (F.col("id") + 4_000_000_000).cast("string"), F.lit("%2F"))
    link = F.concat(F.lit('<a href="https://out.zeta.example/t?m=1&amp;target='), target, F.lit('">'))
    card = F.concat(
        F.lit("<tr><td>"), link, esc(title), F.lit("</a><p>Employer "), F.col("id").cast("string"), F.lit(" Inc &middot; Velden, NY</p><p>"), link,
        F.lit("View job</a></p></td></tr>"),
    )
    cards = table(spark, d, "job").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("id", card.alias("card")))).alias("cards"))
    foot = F.lit('</table><p><a href="https://zeta.example/unsubscribe">Unsubscribe</a> <a href="https://www.linkedin.com/jobs/search/">See all jobs</a></p></body></html>')
    page = F.concat(F.lit("<html><body><table>"), F.array_join(F.transform("cards", lambda c: c["card"]), ""), foot)
    return cards.select("message_id", page.alias("html"), F.lit("").alias("plain"), F.lit("LinkedIn").alias("name"), F.lit("x@linkedin.com").alias("address"), F.lit("Jobs").alias("subject"))


_CARDS = """SELECT message_id, id, row_number() OVER (PARTITION BY message_id ORDER BY id) - 1 AS pos,
    coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')), ''), 'Data Engineer') AS title FROM job"""


@query(
    "digest_candidates",
    f"""SELECT message_id, CAST(pos AS int) AS pos, 'linkedin:' || (id + 4000000000) AS url_key, title, 'Employer ' || id || ' Inc' AS company, 'Velden, NY' AS location,
    'linkedin' AS source FROM ({_CARDS}) WHERE pos < 40""",
)
def _digest_candidates(spark, d):
    """Postings read back from digests made of the postings of each message."""
    found = extract.candidates(_digests(spark, d), "message_id", "html", "plain", "name", "address", "subject")
    return found.select("message_id", "pos", "url_key", "title", "company", "location", "source")


@query(
    "digest_gates",
    f"""SELECT message_id, least(n, 40) AS n, greatest(n_titles, 0) AS expected, greatest(n - 40, 0) AS unclaimed, n_titles >= least(n, 40) + 2 OR n - 40 >= 2 AS asks
    FROM (SELECT message_id, CAST(count(*) AS bigint) AS n, CAST(count(DISTINCT CASE WHEN roles >= 2 OR role THEN print END) AS bigint) AS n_titles
      FROM (SELECT *, count(DISTINCT CASE WHEN role THEN print END) OVER (PARTITION BY message_id) AS roles
        FROM (SELECT *, {_norm_sql('title')} AS print, regexp_matches(title, {quoted(fixed.TITLE_ROLE)}) AS role FROM ({_CARDS}))) GROUP BY 1)""",
)
def _digest_gates(spark, d):
    """How many postings each digest names, how many were found, and whether some seem to be missing."""
    mails = _digests(spark, d)
    found = extract.candidates(mails, "message_id", "html", "plain", "name", "address", "subject").select("message_id", "url_key")
    links = extract.anchors(mails, "message_id", "html", 100_000)
    expected = extract.expected_postings(links, mails, "message_id", "plain")
    return extract.incomplete(found, links, expected, "message_id")


#: Letters and the employer and role they tell: subject, body, sender, address, company, role.
LETTERS = [
    ("Thank you for applying to Data Steward at Orrin Labs", "", "x", "no-reply@greenhouse.io", "Orrin Labs", "Data Steward"),
    ("Your application for Ward Clerk @ Tarn", "", "", "", "Tarn", "Ward Clerk"),
    ("Orrin Labs - interview for Data Engineer", "", "", "", "Orrin Labs", "Data Engineer"),
    ("Your R2031-551 Data Analyst application at Orrin Labs LLP (US", "", "", "", "Orrin Labs LLP", "Data Analyst"),
    ("Update on your application to Tarn", "", "", "", "Tarn", ""),
    ("Thanks for applying to Orrin", "We read your letter.", "", "", "Orrin", ""),
    ("News of Tarn", "This is about the interview for the Ward Clerk position.", "Tarn", "", "Tarn", "Ward Clerk"),
    ("Hello", "You applied for the Data Analyst role at Tarn Works. We will write.", "", "", "Tarn Works", "Data Analyst"),
    ("Hello", "", "Orrin Careers", "x@myworkday.com", "Orrin", ""),
    ("Hello", "", "", "tarn@myworkday.com", "Tarn", ""),
    ("Hello", "", "no-reply", "no-reply@mail.orrin-labs.example", "Orrin Labs", ""),
    ("Machine Learning Engineer", "", "", "hr@greenhouse.io", "", "Machine Learning Engineer"),
    ("", "", "", "", "", ""),
]


@query(
    "company_role",
    "SELECT subject, body, sender, address, company, role FROM (VALUES " + ", ".join(f"({', '.join(map(quoted, x))})" for x in LETTERS) + ") AS t(subject, body, sender, address, company, role)",
)
def _company_role(spark, d):
    """Letters against the employer and role written for them."""
    from missive.functions import roles

    given = spark.createDataFrame([x[:4] for x in LETTERS], "subject string, body string, sender string, address string")
    t = roles.told(F.col("subject"), F.col("body"), F.col("sender"), F.col("address"))
    return given.withColumn("t", t).select("subject", "body", "sender", "address", "t.*")


@query("letters_told")
def _letters_told(spark, d):
    """Employer and role of every stored letter; no SQL, as the patterns name their groups."""
    from missive.functions import roles

    mails = newest_mail(spark, d, "subject", "body_text", "sender", "sender_email")
    t = roles.told(F.col("subject"), F.col("body_text"), F.col("sender"), F.col("sender_email"))
    return mails.select("id", t.alias("t")).select("id", "t.*")


@query(
    "prefix_company_join",
    f"""WITH s AS (SELECT DISTINCT {_norm_sql('company', fixed.COMPANY_NOISE)} AS c FROM outreach), t AS (SELECT DISTINCT {_norm_sql('company', fixed.COMPANY_NOISE)} AS c FROM application)
    SELECT s.c AS outreach_company, t.c AS application_company FROM s JOIN t ON s.c <> '' AND t.c <> '' AND (s.c = t.c OR starts_with(s.c, t.c || ' ') OR starts_with(t.c, s.c || ' '))""",
)
def _prefix_join(spark, d):
    """Companies of letters and of applications that are equal or begin with each other's whole words."""
    names = lambda n, out: table(spark, d, n).select(T.normalise_company(F.col("company")).alias(out)).where(F.col(out) != "").distinct()
    s, t = names("outreach", "outreach_company"), names("application", "application_company")
    same = s.join(t, F.col("outreach_company") == F.col("application_company"))
    return same.unionByName(fold.same_or_longer(s, t, "outreach_company", "application_company"))


_F = f"substr(coalesce(body_text, ''), 1, {fixed.FIELD_TEXT})"
_LABEL = "lower(split_part(split_part(coalesce(sender_email, ''), '@', 2), '.', 1))"


@query(
    "letter_fields",
    f"""SELECT id, coalesce(sender, '') AS person, substr(coalesce(snippet, ''), 1, 300) AS summary,
    array_to_string(list_transform(string_split({_LABEL}, '-'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '-') AS company,
    CASE WHEN {_hit(fixed.URGENT, 'b')} THEN 'high' ELSE 'normal' END AS urgency, substr(trim(regexp_extract(b, {quoted(T.PHONE)}, 0)), 1, 40) AS phone,
    {_employment_sql('b')} AS employment_type, {_clipped(fixed.EXPERIENCE, 'b', 1)} AS experience_required, {_state_sql("''", 'b')} AS state
    FROM (SELECT *, coalesce(subject, '') || chr(10) || {_F} AS b FROM {mail_sql('subject', 'body_text', 'sender', 'sender_email', 'snippet')})""",
)
def _letter_fields(spark, d):
    """What a letter that wants an answer tells besides its category."""
    mails = newest_mail(spark, d, "subject", "body_text", "sender", "sender_email", "snippet")
    text = lambda c: F.coalesce(c, F.lit(""))
    blob = F.concat(text("subject"), F.lit("\n"), F.substring(text("body_text"), 1, fixed.FIELD_TEXT))
    rows = mails.withColumn("b", blob)
    b = F.col("b")
    domain = F.when(F.contains(text("sender_email"), F.lit("@")), F.split(text("sender_email"), "@")[1]).otherwise("")
    label = F.lower(F.substring_index(domain, ".", 1))
    company = F.replace(F.initcap(F.replace(label, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))
    return rows.select(
        "id", text("sender").alias("person"), F.substring(text("snippet"), 1, 300).alias("summary"), company.alias("company"),
        F.when(b.rlike(fixed.URGENT), "high").otherwise("normal").alias("urgency"), fields.phone(b).alias("phone"), fields.employment(b).alias("employment_type"),
        fields.experience(b).alias("experience_required"), fields.state_of(F.lit(""), b).alias("state"),
    )
