"""Named queries over the test tables and the SQL that checks them.

Result conventions: timestamps leave as epoch seconds or text, sums of whole
numbers as bigint, doubles rounded to six digits, arrays joined to text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from missive import fixed
from missive.functions import fields, html, mail, urls
from missive.functions import text as T
from missive.operators import dedup, fold, reports, score
from missive.plans.base import QUERIES, SQL, Query, in_list, query, quoted
from missive.runtime import balanced, table

ZONE = "America/New_York"
CATEGORIES = list(fixed.CATEGORIES)
#: Ranks by which event kinds advance a status, for the queries below.
RANKS = {
    "submitted": 1, "applied": 1, "in_review": 2, "next_step": 3, "assessment": 4, "interview": 5, "offer": 6, "rejected": 7, "withdrawn": 7,
}
CLOSED = {"offer", "rejected", "withdrawn"}

# -- text ------------------------------------------------------------------------
_CLEAN = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({c}, chr(8204), ''), chr(160), ' '),
'[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')
"""


@query("clean_text", f"SELECT doc_id, {_CLEAN.format(c='text')} AS cleaned FROM documents")
def _clean(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def _norm_sql(column: str, noise: tuple[str, ...] = ()) -> str:
    t = f"regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9 ]', ' ', 'g')"
    if noise:
        t = f"regexp_replace({t}, '\\b(?:{'|'.join(noise)})\\b', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_COMPANY, _ROLE = fixed.COMPANY_NOISE, fixed.ROLE_NOISE


@query("normalise_company", f"SELECT id, {_norm_sql('company', _COMPANY)} AS company_key, {_norm_sql('title', _ROLE)} AS role_key FROM job")
def _normalise_company(spark, d):
    return table(spark, d, "job").select("id", T.normalise_company(F.col("company")).alias("company_key"), T.normalise_role(F.col("title")).alias("role_key"))


_KEY_SQL = f"CASE WHEN {_norm_sql('company', _COMPANY)} <> '' AND {_norm_sql('title', _ROLE)} <> '' THEN {_norm_sql('company', _COMPANY)} || '|' || {_norm_sql('title', _ROLE)} ELSE '' END"


@query("pair_key", f"SELECT id, {_KEY_SQL} AS pair_key FROM job")
def _pair_key(spark, d):
    return table(spark, d, "job").select("id", T.pair_key(F.col("company"), F.col("title")).alias("pair_key"))


@query("fingerprint", f"SELECT doc_id, sha256({_norm_sql('text')}) AS fingerprint FROM documents")
def _fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def _fold_sql(column: str) -> str:
    t = f"regexp_replace(regexp_replace(lower(coalesce({column}, '')), 'ai[/-]ml', ' ai ml ', 'g'), '[/-]', ' ', 'g')"
    for long, short in T.TITLE_FOLDS.items():
        t = f"regexp_replace({t}, '\\b{long}\\b', ' {short} ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@query("fold_title", f"SELECT id, {_fold_sql('title')} AS folded FROM job")
def _fold_title(spark, d):
    return table(spark, d, "job").select("id", T.fold_title(F.coalesce("title", F.lit(""))).alias("folded"))


_STOP = ", ".join(map(quoted, T.STOPWORDS))
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce({{c}}, '')), '{T.TOKEN}'), lambda w: NOT list_contains([{_STOP}], w))"


@query(
    "token_counts",
    f"SELECT token, CAST(count(*) AS bigint) AS n, CAST(count(DISTINCT id) AS bigint) AS n_rows FROM (SELECT id, unnest({_TOKENS.replace('{c}', 'description')}) AS token FROM job) GROUP BY token",
)
def _token_counts(spark, d):
    words = table(spark, d, "job").select("id", F.explode(T.tokens(F.col("description"))).alias("token"))
    per_row = words.groupBy("token", "id").agg(F.count("*").alias("k"))
    return per_row.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("n_rows"))


def _years_sql(c: str) -> str:
    low = f"list_transform(regexp_extract_all({c}, '{T.YEARS_BEFORE}', 1), lambda x: TRY_CAST(x AS int))"
    high = f"list_transform(regexp_extract_all({c}, '{T.YEARS_BEFORE}', 2), lambda x: TRY_CAST(x AS int))"
    after = f"list_transform(regexp_extract_all({c}, '{T.YEARS_AFTER}', 1), lambda x: TRY_CAST(x AS int))"
    both = f"list_transform(list_zip({low}, {high}), lambda p: coalesce(p[2], p[1]))"
    return f"least(25, coalesce(list_max(list_concat(list_concat({both}, {after}), [0])), 0))"


@query("years_required", f"SELECT doc_id, {_years_sql('''coalesce(text, '')''')} AS years FROM documents")
def _years(spark, d):
    return table(spark, d, "documents").select("doc_id", T.years_required(F.col("text")).alias("years"))


@query("phone_text", f"SELECT id, substr(coalesce(regexp_extract(body_text, '{T.PHONE}', 0), ''), 1, 40) AS phone FROM (SELECT DISTINCT id, body_text FROM message)")
def _phone(spark, d):
    return table(spark, d, "message").select("id", "body_text").distinct().select("id", T.first_match(F.col("body_text"), T.PHONE, 40).alias("phone"))


# -- scoring ---------------------------------------------------------------------
_P = score.EXAMPLE
_TERMS = score.profile_terms(_P)


def _cosine_sql() -> str:
    parts = " + ".join(f"sqrt(len(list_filter(ws, lambda w: w = {quoted(t)}))) * sqrt({n})" for t, n in sorted(_TERMS.items()))
    return f"CASE WHEN len(ws) > 0 THEN ({parts}) / (sqrt(len(ws)) * sqrt({sum(_TERMS.values())})) ELSE 0.0 END"


_W_DOC, _COS = _TOKENS.replace("{c}", "text"), _cosine_sql()


@query("score_documents", f"SELECT doc_id, round({_COS}, 6) AS cosine FROM (SELECT doc_id, {_W_DOC} AS ws FROM documents)")
def _score_documents(spark, d):
    words = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.round(score.cosine(F.col("words"), _P), 6).alias("cosine"))


def _any_sql(column: str, terms) -> str:
    alone = [t for t in terms if score.stands_alone(t)]
    parts = [f"contains({column}, {quoted(t)})" for t in terms if not score.stands_alone(t)]
    parts += [f"regexp_matches({column}, {quoted(score.alone_pattern(alone))})"] if alone else []
    return "(" + (" OR ".join(parts) or "false") + ")"


def _skill_sql(column: str, skill) -> str:
    return _any_sql(column, (skill[0], *skill[2]))


_TOTAL = sum(s[1] for s in _P.skills)
_COVER = "(" + " + ".join(f"CASE WHEN {_skill_sql('low', s)} THEN {s[1]} ELSE 0.0 END" for s in _P.skills) + f") / {_TOTAL}"


def _skill_list(hit: bool) -> str:
    cases = ", ".join(f"CASE WHEN {'' if hit else 'NOT '}{_skill_sql('low', s)} THEN {quoted(s[0])} END" for s in _P.skills)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ', ')"


@query(
    "skills_match",
    f"SELECT id, round({_COVER}, 6) AS coverage, {_skill_list(True)} AS matched, {_skill_list(False)} AS missing FROM (SELECT id, lower(coalesce(description, '')) AS low FROM job)",
)
def _skills_match(spark, d):
    hits = table(spark, d, "job").select("id", score.skill_hits(F.lower(F.coalesce("description", F.lit(""))), _P).alias("hits"))
    h = F.col("hits")
    return hits.select(
        "id", F.round(score.coverage(h, _P), 6).alias("coverage"), score.skill_names(h, _P, True).alias("matched"), score.skill_names(h, _P, False).alias("missing")
    )


def _wanted_sql() -> str:
    parts = []
    for target in _P.titles:
        own = [w for w in score.folded(target).split() if w not in fixed.WEAK_TITLE_WORDS]
        parts += [f"contains(t, {quoted(target)})", f"contains(f, {quoted(score.folded(target))})", f"list_has_all(tw, [{in_list(own)}])"]
    return "(" + " OR ".join(parts) + ")"


_WORDS = " + ".join(f"CAST({_any_sql('t', (w,))} OR {_any_sql('f', (w,))} AS int)" for w in _P.title_words)
_TITLE = f"CASE WHEN t = '' THEN 0.35 WHEN {_wanted_sql()} THEN 1.0 WHEN {_WORDS} >= 2 THEN 0.75 WHEN {_WORDS} = 1 THEN 0.5 ELSE 0.1 END"
_BAD_TITLE = f"regexp_matches(t, {quoted(score.alone_pattern(list(_P.excluded_titles)))})"
_TITLED = f"""SELECT *, list_filter(regexp_extract_all(f, '[a-z0-9+#]+'), lambda w: w NOT IN ({in_list(fixed.WEAK_TITLE_WORDS)})) AS tw
    FROM (SELECT *, lower(trim(coalesce(title, ''))) AS t, {_fold_sql('trim(title)')} AS f FROM job)"""


@query(
    "title_tiers",
    f"""SELECT id, CAST({_TITLE} AS double) AS tier, NOT {_BAD_TITLE} AND {_TITLE} >= 0.5 AND (NOT regexp_matches(coalesce(title, ''), {quoted(fixed.STUDENT_TITLE)})
    OR {_TITLE} >= 1.0) AS worth_reading FROM ({_TITLED})""",
)
def _title_tiers(spark, d):
    rows = score.with_title_score(table(spark, d, "job").select("id", "title"), "title", _P)
    return rows.select("id", F.col("title_score").cast("double").alias("tier"), score.worth_reading(rows, "title").alias("worth_reading"))


def _visa_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {quoted(p)}) THEN {quoted(label)}" for p, label, _ in fields.VISA_RULES) + " ELSE '' END"


_WORD_SQL = "CASE " + " ".join(f"WHEN contains(low, {quoted(w)}) THEN {quoted(w)}" for w in _P.excluded_words) + " ELSE '' END"
_PLACE_SQL = "(" + " OR ".join(f"contains(blob, {quoted(p)})" for p in _P.places) + f" OR regexp_matches(blob, {quoted(fixed.REMOTE_HINT)}))"
_A, _B, _C = _P.weights
_MATCHED = f"""
    SELECT *, least(1.0, greatest(0.0, {_A} * tier + {_B} * skill + {_C} * resume - CASE WHEN years > {_P.most_years + _P.years_grace} THEN {_P.years_malus} ELSE 0.0 END
        - CASE WHEN place THEN 0.0 ELSE {_P.place_malus} END)) AS raw,
        CASE WHEN word <> '' THEN 'rejected: contains ' || chr(39) || word || chr(39) WHEN note IN ({in_list(_P.excluded_notes)}) THEN 'rejected: ' || lower(note)
        WHEN bad THEN 'rejected: excluded title' ELSE '' END AS why
    FROM (SELECT *, CAST({_TITLE} AS double) AS tier, {_BAD_TITLE} AS bad, least(1.0, ({_COVER}) / {_P.full_coverage}) AS skill,
        least(1.0, ({_COS}) / {_P.full_cosine}) AS resume, {_WORD_SQL} AS word, {_visa_sql('txt')} AS note, {_PLACE_SQL} AS place,
        {_years_sql("coalesce(description, '')")} AS years
      FROM (SELECT *, lower(txt) AS low, {_TOKENS.replace('{c}', 'txt')} AS ws, lower(coalesce(location, '') || ' ' || substr(coalesce(description, ''), 1, 2000)) AS blob
        FROM (SELECT *, coalesce(title, '') || chr(10) || coalesce(company, '') || chr(10) || coalesce(location, '') || chr(10) || coalesce(description, '') AS txt
          FROM ({_TITLED}))))"""


def _kept(value: str) -> str:
    return f"CASE WHEN why = '' THEN {value} ELSE 0.0 END"


def _matched_rows(spark, d):
    job = table(spark, d, "job").select("id", "title", "company", "location", "description", "received_at")
    return score.matched(balanced(job), _P, "title", "description", "location", "company")


@query(
    "score_jobs",
    f"""SELECT id, {_kept('round(raw, 3)')} AS score, {_kept('tier')} AS title_score, {_kept('round(skill, 3)')} AS skill_score, {_kept('round(resume, 3)')} AS resume_score,
    CASE WHEN why = '' THEN {_skill_list(True)} ELSE '' END AS matched_skills, why AS rejected_for, why = '' AND round(raw, 3) >= {_P.least_score} AS matched,
    CASE WHEN why <> '' THEN 0 ELSE years END AS years FROM ({_MATCHED})""",
)
def _score_jobs(spark, d):
    rows = _matched_rows(spark, d)
    years = F.coalesce(F.regexp_extract("verdict", r"wants (\d+)y", 1).try_cast("int"), F.lit(0))
    return rows.select(
        "id", "score", "title_score", "skill_score", "resume_score", "matched_skills", F.when(F.col("rejected"), F.col("verdict")).otherwise("").alias("rejected_for"),
        "matched", years.alias("years"),
    )


@query("top_matches", f"SELECT id, title, company, round(raw, 3) AS score FROM ({_MATCHED}) WHERE why = '' ORDER BY score DESC, received_at DESC, id LIMIT 300")
def _top_matches(spark, d):
    """The 300 best postings: a top-k report."""
    rows = _matched_rows(spark, d).where("NOT rejected").select("id", "title", "company", "score", "received_at")
    return rows.orderBy(F.desc("score"), F.desc("received_at"), "id").limit(300).drop("received_at")


@query(
    "promoted_scores",
    f"""SELECT id, CASE WHEN scrape_status <> 'ok' AND title_score >= 0.75 AND score < {_P.least_score} THEN {_P.least_score} ELSE score END AS score
    FROM (SELECT id, coalesce(scrape_status, '') AS scrape_status, title_score, score FROM job)""",
)
def _promoted(spark, d):
    ok = F.coalesce("scrape_status", F.lit("")) == "ok"
    return table(spark, d, "job").select("id", score.promoted(F.col("score"), F.col("title_score"), F.lit(False), ok, _P).alias("score"))


# -- duplicates ------------------------------------------------------------------
_ROOT = f"first_value(doc_id) OVER (PARTITION BY k ORDER BY collected_at, doc_id)"


@query(
    "dedup_root",
    f"""SELECT doc_id, CASE WHEN k = '' THEN doc_id ELSE {_ROOT} END AS root_id
    FROM (SELECT doc_id, collected_at, {_norm_sql('text')} AS k FROM documents)""",
)
def _dedup_root(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "collected_at", T.normalise_name(F.col("text")).alias("k"))
    return dedup.with_root(docs, F.when(F.col("k") != "", F.sha2("k", 256)).otherwise(""), ["collected_at", "doc_id"], id_column="doc_id").select("doc_id", "root_id")


@query(
    "dedup_pointer",
    """SELECT id, dupe_key, first_value(id) OVER w AS root_id, row_number() OVER w - 1 AS seq FROM job
    WHERE dupe_key IS NOT NULL AND dupe_key <> '' WINDOW w AS (PARTITION BY dupe_key ORDER BY received_at, id)""",
)
def _dedup_pointer(spark, d):
    rows = table(spark, d, "job").where("dupe_key IS NOT NULL AND dupe_key <> ''").select("id", "dupe_key", "received_at")
    return dedup.pointers(rows, "dupe_key", ["received_at", "id"])


@query(
    "dedup_best",
    """SELECT id, processed_at_s, summary FROM (SELECT id, CAST(epoch(processed_at) AS bigint) AS processed_at_s, summary,
    row_number() OVER (PARTITION BY id ORDER BY processed_at DESC, coalesce(summary, '')) AS r FROM message) WHERE r = 1""",
)
def _dedup_best(spark, d):
    rows = table(spark, d, "message").select("id", F.unix_seconds("processed_at").alias("processed_at_s"), "summary", "processed_at")
    best = dedup.best_per_key(rows, ["id"], [-F.unix_micros("processed_at"), F.coalesce("summary", F.lit(""))])
    return best.select("id", "processed_at_s", "summary")


@query(
    "dedup_suppress",
    """SELECT id, message_id FROM (SELECT id, message_id, company, max(CASE WHEN coalesce(company, '') <> '' THEN 1 ELSE 0 END) OVER
    (PARTITION BY message_id, lower(title) ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM job)
    WHERE coalesce(company, '') <> '' OR coalesce(seen, 0) = 0""",
)
def _dedup_suppress(spark, d):
    rows = table(spark, d, "job").select("id", "message_id", "title", "company")
    return dedup.suppress_repeats(rows, "message_id", F.col("title"), F.col("company"), ["id"]).select("id", "message_id")


# -- URLs, HTML, mail ------------------------------------------------------------
@query(
    "url_host",
    r"""SELECT id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host FROM job""",
)
def _url_host(spark, d):
    return table(spark, d, "job").select("id", F.coalesce(urls.url_parts(F.col("url"))["host"], F.lit("")).alias("host"))


@query("url_unwrap", "SELECT id, url AS unwrapped FROM job")
def _url_unwrap(spark, d):
    """Every posting URL behind a click tracker and unwrapped again: a round trip."""
    wrapped = F.concat(F.lit("https://click.mailer.example/track?u=17&url="), F.url_encode("url"))
    return table(spark, d, "job").select("id", urls.url_parts(wrapped)["unwrapped"].alias("unwrapped"))


def _page():
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(
        F.lit("<html><head><title>x</title><script>var a=1</script></head><body><nav><a href='https://home.example/'>Home</a></nav><h1>"), esc("title"),
        F.lit("</h1><p>"), esc("company"), F.lit("</p><a href='"), F.col("url"), F.lit("'>"), esc("title"), F.lit("</a></body></html>"),
    )


_SQUEEZE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


@query(
    "html_text",
    f"SELECT id, array_to_string(list_filter(['Home', {_SQUEEZE('title')}, {_SQUEEZE('company')}, {_SQUEEZE('title')}], lambda x: x <> ''), chr(10)) AS text FROM job",
)
def _html_text(spark, d):
    """Pages made of the postings' fields, read back as text."""
    return table(spark, d, "job").select("id", html.html_to_text(_page()).alias("text"))


@query("html_links", f"SELECT id, 'https://home.example/' AS url, 'Home' AS label FROM job UNION ALL SELECT id, url, trim(coalesce(title, '')) FROM job")
def _html_links(spark, d):
    links = table(spark, d, "job").select("id", F.explode(html.html_links(_page())).alias("l"))
    return links.select("id", "l.url", F.col("l.text").alias("label"))


@query(
    "mail_parse",
    """SELECT id, trim(coalesce(sender, '')) AS sender, lower(coalesce(sender_email, '')) AS sender_email, coalesce(subject, '') AS subject, coalesce(body_text, '') AS text,
    'multipart/mixed,application/pdf,multipart/alternative,text/html,text/plain' AS parts FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY processed_at DESC,
    sender NULLS FIRST, sender_email NULLS FIRST, subject NULLS FIRST, body_text NULLS FIRST) AS r FROM message) WHERE r = 1""",
)
def _mail_parse(spark, d):
    """Messages packed as mailbox payloads with nested parts and parsed back: a round trip."""
    columns = ("sender", "sender_email", "subject", "body_text")
    m = table(spark, d, "message").select("id", "processed_at", "thread_id", "snippet", "received_at", *columns)
    m = dedup.best_per_key(m, ["id"], [-F.unix_micros("processed_at"), *map(F.col, columns)])
    text = lambda c: F.coalesce(c, F.lit(""))
    body = lambda data: F.struct(data.alias("data")).alias("body")
    kind = lambda name: F.lit(name).alias("mimeType")
    coded = F.translate(F.base64(F.encode(text("body_text"), "UTF-8")), "+/\r\n", "-_")
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    leaf = lambda name, data: F.struct(kind(name), body(data))
    markup = F.base64(F.encode(F.lit("<p>x</p>"), "UTF-8"))
    inner = F.struct(kind("multipart/alternative"), F.array(leaf("text/plain", coded), leaf("text/html", markup)).alias("parts"))
    sender = F.concat(F.lit('"'), text("sender"), F.lit('" <'), text("sender_email"), F.lit(">"))
    outer = F.to_json(F.struct(kind("multipart/mixed"), F.array(head("From", sender), head("Subject", text("subject"))).alias("headers")))
    # The parts are of different shapes, so they are put in as text.
    parts = F.concat_ws(",", F.to_json(inner), F.to_json(leaf("application/pdf", F.lit(""))))
    plain = F.concat(F.regexp_replace(outer, r"\}$", ""), F.lit(',"parts":['), parts, F.lit("]}"))
    raw = m.select("id", F.col("thread_id").alias("threadId"), "snippet", F.unix_millis("received_at").cast("string").alias("internalDate"), plain.alias("payload"))
    parsed = mail.parse_mail(raw)
    return parsed.select("id", F.col("sender_name").alias("sender"), "sender_email", "subject", "text", F.array_join("part_types", ",").alias("parts"))


@query("json_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k FROM events")
def _json_payload(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# -- state -----------------------------------------------------------------------
_RANK_SQL = "CASE kind " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in RANKS.items()) + " ELSE 0 END"
_CLOSED_SQL = ", ".join(map(quoted, sorted(CLOSED)))


@query(
    "fold_status",
    f"""SELECT application_id, kind AS status, n AS n_events, kind IN ({_CLOSED_SQL}) AS closed FROM (
    SELECT application_id, kind, row_number() OVER (PARTITION BY application_id ORDER BY {_RANK_SQL} DESC, occurred_at, id) AS r,
    CAST(count(*) OVER (PARTITION BY application_id) AS bigint) AS n FROM (SELECT DISTINCT id, application_id, kind, occurred_at FROM application_event)) WHERE r = 1""",
)
def _fold_status(spark, d):
    events = table(spark, d, "application_event").select("id", "application_id", "kind", "occurred_at").distinct()
    return fold.fold_status(events, "application_id", "kind", ["occurred_at", "id"], RANKS, CLOSED)


@query(
    "fold_last_event",
    """SELECT application_id, kind AS last_event, CAST(epoch(occurred_at) AS bigint) AS last_event_s FROM (SELECT *, row_number() OVER
    (PARTITION BY application_id ORDER BY occurred_at DESC, id DESC) AS r FROM (SELECT DISTINCT id, application_id, kind, occurred_at FROM application_event)) WHERE r = 1""",
)
def _fold_last_event(spark, d):
    last = fold.last_event(table(spark, d, "application_event"), "application_id", ["occurred_at", "id"], "kind", "occurred_at")
    return last.select("application_id", F.col("kind").alias("last_event"), F.unix_seconds("occurred_at").alias("last_event_s"))


@query(
    "fold_sticky",
    """SELECT application_id, arg_max(summary, {'a': occurred_at, 'b': id}) AS summary FROM (SELECT DISTINCT * FROM application_event)
    WHERE summary IS NOT NULL AND summary <> '' GROUP BY application_id""",
)
def _fold_sticky(spark, d):
    return fold.sticky(table(spark, d, "application_event"), "application_id", "summary", ["occurred_at", "id"])


_NOW = "(SELECT max(last_event_at) FROM application)"


@query(
    "stale_entities",
    f"SELECT id, company, role FROM application WHERE NOT closed AND last_event_at < {_NOW} - INTERVAL 14 DAY",
)
def _stale(spark, d):
    apps = table(spark, d, "application")
    # A scalar subquery, evaluated once.
    now = apps.agg(F.max("last_event_at").alias("now")).scalar()
    return apps.where("NOT closed").where(F.col("last_event_at") < now - F.expr("INTERVAL 14 DAYS")).select("id", "company", "role")


@query(
    "application_sheet",
    """SELECT a.id, a.status, e.place, e.kind FROM application a LEFT JOIN (SELECT application_id, kind, CAST(row_number() OVER (PARTITION BY application_id
    ORDER BY occurred_at DESC, id DESC) AS bigint) AS place FROM (SELECT DISTINCT id, application_id, kind, occurred_at FROM application_event)) e ON a.id = e.application_id""",
)
def _sheet(spark, d):
    """Applications with their events, newest first."""
    events = table(spark, d, "application_event").select(F.col("id").alias("event_id"), "application_id", "kind", "occurred_at").distinct()
    lines = fold.timeline(events, "application_id", "occurred_at", "event_id", "kind")
    apps = table(spark, d, "application").select("id", "status")
    return apps.join(lines, F.col("id") == F.col("application_id"), "left").select("id", "status", "place", "kind")


# -- joins and filters -----------------------------------------------------------
@query(
    "mail_bundle",
    """SELECT m.id, coalesce(j.n, 0) AS n_jobs, coalesce(j.k, 0) AS n_matched, coalesce(o.o, 0) AS last_outreach FROM (SELECT DISTINCT id FROM message) m
    LEFT JOIN (SELECT message_id, CAST(count(*) AS bigint) AS n, CAST(count(*) FILTER (WHERE matched) AS bigint) AS k FROM job GROUP BY 1) j ON m.id = j.message_id
    LEFT JOIN (SELECT message_id, max(id) AS o FROM outreach GROUP BY 1) o ON m.id = o.message_id""",
)
def _mail_bundle(spark, d):
    jobs = table(spark, d, "job").groupBy("message_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("k"))
    last = table(spark, d, "outreach").groupBy("message_id").agg(F.max("id").alias("o"))
    mails = table(spark, d, "message").select(F.col("id").alias("message_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return mails.join(jobs, "message_id", "left").join(last, "message_id", "left").select(
        F.col("message_id").alias("id"), zero("n").alias("n_jobs"), zero("k").alias("n_matched"), zero("o").alias("last_outreach")
    )


@query("unstored_anti", "SELECT DISTINCT id, jobs_found FROM message m WHERE jobs_found > 0 AND NOT EXISTS (SELECT 1 FROM job j WHERE j.message_id = m.id)")
def _unstored(spark, d):
    stored = table(spark, d, "job").select(F.col("message_id").alias("id"))
    return table(spark, d, "message").where("jobs_found > 0").join(stored, "id", "left_anti").select("id", "jobs_found").distinct()


@query("in_semi", "SELECT id, title FROM job WHERE message_id IN (SELECT id FROM message WHERE category = 'job_alert')")
def _in_semi(spark, d):
    alerts = table(spark, d, "message").where("category = 'job_alert'").select(F.col("id").alias("message_id"))
    return table(spark, d, "job").join(alerts, "message_id", "left_semi").select("id", "title")


_WIN = "received_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND received_at < TIMESTAMPTZ '2025-04-01 00:00:00+00'"


@query(
    "purge_plan",
    f"""WITH gone AS (SELECT DISTINCT id FROM message WHERE {_WIN})
    SELECT 'parent' AS "table", CAST(count(*) AS bigint) AS n FROM gone
    UNION ALL SELECT 'job', CAST(count(*) AS bigint) FROM job WHERE ({_WIN}) OR message_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'outreach', CAST(count(*) AS bigint) FROM outreach WHERE ({_WIN}) OR message_id IN (SELECT id FROM gone)""",
)
def _purge(spark, d):
    window = (F.col("received_at") >= F.lit("2025-01-01").cast("timestamp")) & (F.col("received_at") < F.lit("2025-04-01").cast("timestamp"))
    child = lambda n: table(spark, d, n).select("message_id", window.alias("own"))
    return reports.purge_plan(
        table(spark, d, "message"), {n: (child(n), "message_id", "own") for n in ("job", "outreach")}, window, "id"
    )


@query("purge_apply", f"SELECT id FROM job WHERE NOT (({_WIN}) OR message_id IN (SELECT id FROM message WHERE {_WIN}))")
def _purge_apply(spark, d):
    window = (F.col("received_at") >= F.lit("2025-01-01").cast("timestamp")) & (F.col("received_at") < F.lit("2025-04-01").cast("timestamp"))
    gone = table(spark, d, "message").where(window).select(F.col("id").alias("message_id")).distinct()
    return table(spark, d, "job").where(~window).join(gone, "message_id", "left_anti").select("id")


@query("fk_null_out", f"SELECT a.id, CASE WHEN j.id IS NULL THEN NULL ELSE a.job_id END AS job_id FROM application a LEFT JOIN (SELECT id FROM job WHERE NOT matched) j ON a.job_id = j.id")
def _fk_null(spark, d):
    kept = table(spark, d, "job").where("NOT matched").select(F.col("id").alias("kept"))
    return table(spark, d, "application").join(kept, F.col("job_id") == F.col("kept"), "left").select("id", F.when(F.col("kept").isNotNull(), F.col("job_id")).alias("job_id"))


@query("search_like", "SELECT id FROM job WHERE lower(coalesce(title, '')) LIKE '%data%' OR lower(coalesce(company, '')) LIKE '%data%' OR lower(coalesce(location, '')) LIKE '%data%'")
def _search(spark, d):
    return reports.search(table(spark, d, "job"), "Data", "title", "company", "location").select("id")


@query(
    "latest_job_per_key",
    "SELECT dupe_key, arg_max(id, {'a': received_at, 'b': id}) AS id FROM job WHERE dupe_key <> '' GROUP BY dupe_key",
)
def _latest_job(spark, d):
    return table(spark, d, "job").where("dupe_key <> ''").groupBy("dupe_key").agg(F.max_by("id", F.struct("received_at", "id")).alias("id"))


@query(
    "latest_per_group",
    "SELECT user_id, event_type, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY user_id, event_type",
)
def _latest(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# -- reports ---------------------------------------------------------------------
_LABELS = " UNION ALL ".join(f"SELECT {i} AS position, {quoted(c)} AS label" for i, c in enumerate(CATEGORIES))


@query(
    "breakdown_zero_fill",
    f"""SELECT coalesce(k.label, c.label) AS label, CAST(coalesce(c.n, 0) AS bigint) AS n, coalesce(k.position, {len(CATEGORIES)}) AS position FROM ({_LABELS}) k
    FULL JOIN (SELECT category AS label, count(*) AS n FROM message GROUP BY 1) c ON k.label = c.label""",
)
def _breakdown(spark, d):
    return reports.zero_filled(table(spark, d, "message"), "category", CATEGORIES)


@query(
    "conditional_counts",
    """SELECT CAST(count(*) AS bigint) AS stored, CAST(count(*) FILTER (WHERE matched) AS bigint) AS matched, CAST(count(*) FILTER (WHERE status = 'ignored') AS bigint) AS ignored,
    CAST(count(*) FILTER (WHERE duplicate_of IS NOT NULL) AS bigint) AS duplicates, CAST(count(*) FILTER (WHERE scraped) AS bigint) AS scraped FROM job""",
)
def _counts(spark, d):
    c = F.col
    return reports.counts(
        table(spark, d, "job"), stored=F.lit(True), matched=c("matched"), ignored=c("status") == "ignored",
        duplicates=c("duplicate_of").isNotNull(), scraped=c("scraped"),
    )


@query(
    "funnel_rates",
    """SELECT source, CAST(count(*) AS bigint) AS n, CAST(count(*) FILTER (WHERE status IN ('interview', 'offer')) AS bigint) AS interviews,
    round(count(*) FILTER (WHERE status IN ('interview', 'offer')) / greatest(1, count(*)), 6) AS interview_rate,
    round(count(*) FILTER (WHERE status = 'offer') / greatest(1, count(*)), 6) AS offer_rate FROM application GROUP BY source""",
)
def _funnel(spark, d):
    n, reached = F.count("*"), F.count_if(F.col("status").isin("interview", "offer"))
    return table(spark, d, "application").groupBy("source").agg(
        n.alias("n"), reached.alias("interviews"), F.round(reached / F.greatest(F.lit(1), n), 6).alias("interview_rate"),
        F.round(F.count_if(F.col("status") == "offer") / F.greatest(F.lit(1), n), 6).alias("offer_rate"),
    )


@query(
    "issue_rollup",
    """SELECT source, scrape_status, CAST(count(*) AS bigint) AS n, CAST(grouping(source, scrape_status) AS bigint) AS level FROM (SELECT source, coalesce(nullif(scrape_status, ''), 'unknown') AS scrape_status FROM job)
    GROUP BY GROUPING SETS ((source, scrape_status), (source), (scrape_status), ())""",
)
def _rollup(spark, d):
    rows = table(spark, d, "job").select("source", T.first_filled(F.col("scrape_status"), F.lit("unknown")).alias("scrape_status"))
    return reports.rollup(rows, "source", "scrape_status")


@query("source_counts", "SELECT source, CAST(count(*) AS bigint) AS n, round(avg(score), 6) AS mean_score FROM job GROUP BY source")
def _source_counts(spark, d):
    return table(spark, d, "job").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("follow_ups", "SELECT id, person, urgency FROM outreach WHERE NOT handled ORDER BY received_at DESC, id LIMIT 300")
def _follow_ups(spark, d):
    """The 300 newest open follow-ups: a top-k report."""
    return table(spark, d, "outreach").where("NOT handled").orderBy(F.desc("received_at"), "id").limit(300).select("id", "person", "urgency")


@query(
    "daily_runs",
    f"""SELECT row_number() OVER (ORDER BY dd) AS run, strftime(dd, '%A, %b %d') AS day, n FROM (SELECT CAST(timezone('{ZONE}', timezone('UTC', ts)) AS date) AS dd, CAST(count(*) AS bigint) AS n FROM events GROUP BY 1)""",
)
def _daily(spark, d):
    return reports.day_runs(table(spark, d, "events"), "ts", ZONE)


_ORIGIN = 1704068000


@query(
    "poll_windows",
    f"""SELECT s AS window_start, s + 900 AS window_end, CAST(count(*) AS bigint) AS n FROM (SELECT CAST({_ORIGIN} + floor((floor(epoch(ts)) - {_ORIGIN}) / 900.0) * 900 AS bigint) AS s
    FROM events WHERE epoch(ts) >= {_ORIGIN}) GROUP BY s""",
)
def _poll(spark, d):
    return reports.origin_windows(table(spark, d, "events"), "ts", 900, F.lit(_ORIGIN))


@query(
    "oldest_stored",
    """SELECT CAST(min(s) AS bigint) AS oldest_s FROM (SELECT floor(epoch(min(received_at))) AS s FROM message UNION ALL SELECT floor(epoch(min(received_at))) FROM job
    UNION ALL SELECT floor(epoch(min(received_at))) FROM outreach UNION ALL SELECT floor(epoch(min(occurred_at))) FROM application_event)""",
)
def _oldest(spark, d):
    least = lambda n, c: table(spark, d, n).agg(F.min(F.unix_seconds(c)).alias("s"))
    parts = [least("message", "received_at"), least("job", "received_at"), least("outreach", "received_at"), least("application_event", "occurred_at")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.min("s").alias("oldest_s"))

# -- lists and facets ------------------------------------------------------------
@query(
    "matches_search",
    """SELECT id, score FROM job WHERE score >= 0.3 AND duplicate_of IS NULL AND (lower(coalesce(title, '')) LIKE '%engineer%' OR lower(coalesce(company, '')) LIKE '%engineer%'
    OR lower(coalesce(location, '')) LIKE '%engineer%') ORDER BY score DESC, received_at DESC, id LIMIT 300""",
)
def _matches_search(spark, d):
    """The 300 best postings of a search: a top-k report."""
    from missive.operators import facets

    return facets.matches(table(spark, d, "job"), needle="Engineer", least=0.3, duplicates=False, sort="score").select("id", "score")


@query(
    "mail_facets",
    """SELECT 'jobs' AS facet, CAST(count(DISTINCT id) AS bigint) AS n FROM message WHERE id IN (SELECT message_id FROM job)
    UNION ALL SELECT 'norows', CAST(count(DISTINCT id) AS bigint) FROM message WHERE category = 'job_alert' AND id NOT IN (SELECT message_id FROM job WHERE message_id IS NOT NULL)
    UNION ALL SELECT 'unstored', CAST(count(DISTINCT id) AS bigint) FROM message WHERE jobs_found > 0 AND id NOT IN (SELECT message_id FROM job WHERE message_id IS NOT NULL)
    UNION ALL SELECT 'followups', CAST(count(DISTINCT id) AS bigint) FROM message WHERE id IN (SELECT message_id FROM outreach)
    UNION ALL SELECT 'other', CAST(count(DISTINCT id) AS bigint) FROM message WHERE category = 'other'""",
)
def _mail_facets(spark, d):
    from missive.operators import facets

    mails, jobs, outreach = (table(spark, d, n) for n in ("message", "job", "outreach"))
    mails = mails.select("id", "category", "jobs_found")
    parts = [
        facets.facet(mails, jobs, outreach, k).agg(F.countDistinct("id").alias("n")).select(F.lit(k).alias("facet"), "n")
        for k in ("jobs", "norows", "unstored", "followups", "other")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "miss_tags",
    """SELECT id, array_to_string(list_filter([CASE WHEN length(coalesce(description, '')) < 40 THEN 'empty' END, CASE WHEN length(coalesce(description, '')) < 250 THEN 'thin' END,
    CASE WHEN coalesce(company, '') = '' THEN 'no_company' END, CASE WHEN coalesce(title, '') = '' THEN 'no_title' END], lambda x: x IS NOT NULL), ',') AS tags FROM job""",
)
def _miss_tags(spark, d):
    from missive.operators import facets

    size = F.length(F.coalesce("description", F.lit("")))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    tags = facets.tags(empty=size < 40, thin=size < 250, no_company=blank("company"), no_title=blank("title"))
    return table(spark, d, "job").select("id", F.array_join(tags, ",").alias("tags"))


@query("day_labels", f"SELECT event_id, strftime(timezone('{ZONE}', timezone('UTC', ts)), '%A, %b %d') AS day FROM events")
def _day_labels(spark, d):
    from missive.functions import times

    return table(spark, d, "events").select("event_id", times.day_label(F.col("ts"), ZONE).alias("day"))


@query(
    "real_dates",
    "SELECT id, CAST(TRY_CAST(CASE WHEN regexp_matches(posted_at, '^\\d{4}-\\d{2}-\\d{2}$') THEN posted_at END AS date) AS varchar) AS day FROM job",
)
def _real_dates(spark, d):
    shaped = F.when(F.col("posted_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("posted_at"))
    return table(spark, d, "job").select("id", F.date_format(F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("day"))


def queries() -> dict[str, Query]:
    from missive.plans import lists, records  # noqa: F401 - they register theirs
    from missive.streaming import queries as streams

    return QUERIES | streams.queries()


def oracle_sql() -> dict[str, str]:
    from missive.plans import lists, records  # noqa: F401
    from missive.streaming import queries as streams

    return SQL | streams.oracle_sql()
