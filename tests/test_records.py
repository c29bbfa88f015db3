import pytest
from pyspark.sql import functions as F

from missive.functions import fields, html, roles
from missive.operators import classify

MAILS = [
    ("board alert", "New jobs for you", "see below", "x@alerts.linkedin.com", 0, ("job_alert", 0.95)),
    ("listed sender", "Your job alert", "", "News@Zeta.example", 0, ("job_alert", 0.95)),
    ("offer", "Hello", "We are pleased to offer you the role", "a@zeta.example", 0, ("offer", 0.9)),
    ("rejection", "Update", "Unfortunately we went with other candidates", "a@zeta.example", 0, ("rejection", 0.85)),
    ("video", "Hello", "Please record a short video", "a@zeta.example", 0, ("next_step", 0.85)),
    ("interview", "Hello", "Can we schedule an interview?", "a@zeta.example", 0, ("interview_invite", 0.85)),
    ("test", "Hello", "Here is your take-home", "a@zeta.example", 0, ("assessment", 0.85)),
    ("step", "Hello", "Kindly fill out the attached form", "a@zeta.example", 0, ("next_step", 0.8)),
    ("code", "Your verification code", "4711", "a@zeta.example", 3, ("other", 0.95)),
    ("receipt", "Hello", "We received your application", "a@zeta.example", 0, ("application_update", 0.8)),
    ("board links", "Hello", "look", "x@indeed.com", 2, ("job_alert", 0.9)),
    ("links", "Hello", "look", "a@zeta.example", 2, ("job_alert", 0.85)),
    ("one link", "Job alert", "look", "a@zeta.example", 1, ("job_alert", 0.75)),
    ("recruiter", "Hello", "I came across your profile", "a@zeta.example", 0, ("recruiter_outreach", 0.85)),
    ("robot", "Hello", "I came across your profile", "no-reply@zeta.example", 0, ("recruiter_outreach", 0.6)),
    ("marketing", "Hello", "Our new course", "a@zeta.example", 0, ("other", 0.7)),
    ("nothing", None, None, None, None, ("other", 0.3)),
    # Findings that come before the rules.
    ("code first", "Offer letter", "Your code is 123456", "a@zeta.example", 0, ("other", 0.95)),
    ("receipt first", "Job alert", "Thank you for applying. Unfortunately other candidates", "a@linkedin.com", 0, ("application_update", 0.85)),
    ("receipt with an ask", "Thanks", "Thank you for applying, now schedule a call", "a@zeta.example", 0, ("interview_invite", 0.85)),
]


def test_every_rule_and_what_comes_before(spark):
    rows = spark.createDataFrame([m[:5] for m in MAILS], "name string, subject string, body string, address string, n long")
    got = {r.name: r for r in classify.classified(rows, "subject", "body", "address", F.col("n"), ("news@zeta.example",)).collect()}
    assert {k: (r.category, r.confidence) for k, r in got.items()} == {m[0]: m[5] for m in MAILS}
    assert got["code"].email_type == "security" and got["nothing"].email_type == "unclassified" and got["offer"].email_type == ""
    assert got["links"].reason == "2 posting links extracted" and got["nothing"].reason == "no rule matched"


def test_classified_replaces_columns_of_its_names(spark):
    rows = spark.createDataFrame([("Hi", "", "", "old", 1)], "subject string, body string, address string, category string, n long")
    got = classify.classified(rows, "subject", "body", "address", F.col("n"))
    assert sorted(got.columns) == ["address", "body", "category", "confidence", "email_type", "n", "reason", "subject"]
    assert got.where("false").count() == 0


@pytest.mark.parametrize(
    "make, cases",
    [
        (fields.employment, {"Full time, W2 only": "Full-Time", "c2c or W2": "C2C", "a contractor": "Contract", "nothing": "", None: ""}),
        (fields.experience, {"at least 3 - 5  years of data experience": "at least 3 - 5 years of data experience", "Senior level": "Senior level", None: ""}),
        (fields.salary, {"pays $120,000 - $150,000 a year": "$120,000 - $150,000", "90-110k": "90-110k", "$45/hr": "$45/hr", "5 apples": "", None: ""}),
        (fields.visa, {"No sponsorship; TS/SCI needed": "Clearance required", "we do not sponsor": "No sponsorship", "US citizens only": "US citizen / GC only",
                       "will sponsor visas": "H-1B sponsorship", "OPT welcome": "OPT/CPT mentioned", "we read": "", None: ""}),
        (fields.skills, {"R and SQL, no Scalability": "sql, r, scala", "rust": "", None: ""}),
        (fields.phone, {"call 212 555 0123 now": "212 555 0123", None: ""}),
    ],
)
def test_extractors(spark, make, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", make(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases


def test_state_prefers_the_location(spark):
    rows = [("Remote, TX", ""), ("Remote", "in OH"), (None, "work in OH"), (None, "remote, in OH"), (None, None)]
    df = spark.createDataFrame(rows, "l string, t string")
    assert [r.s for r in df.select(fields.state_of(F.col("l"), F.col("t")).alias("s")).collect()] == ["TX", "Remote", "OH", "Remote", ""]


def test_visa_label_keeps_known_notes_only(spark):
    df = spark.createDataFrame([("H-1B  sponsorship", ""), ("maybe", ""), (None, None), ("maybe", "cannot sponsor")], "g string, t string")
    got = [r.v for r in df.select(fields.visa_label(F.col("g"), F.col("t")).alias("v")).collect()]
    assert got == ["H-1B sponsorship", "", "", "No sponsorship"]


def test_enrichment_fills_blanks_only(spark):
    df = spark.createDataFrame([("", "Part-time", "Oslo, NY", "full-time, $90,000, 2024-05-06, python"), (None, None, None, None)], "salary string, kind string, place string, text string")
    told = fields.enriched({"salary": F.col("salary"), "employment_type": F.col("kind")}, F.lit("lever"), F.lit(""), F.lit("lever:a:b"), F.col("place"), F.col("text"))
    got = df.select(*(c.alias(n) for n, c in told.items())).collect()
    assert (got[0].salary, got[0].employment_type, got[0].state, got[0].posted_at, got[0].posting_id) == ("$90,000", "Part-time", "NY", "2024-05-06", "a:b")
    assert got[0].source_type == "official_career_site" and got[0].required_skills == "python, r"[:6] and got[1].salary == ""


def test_scheduling_url(spark):
    df = spark.createDataFrame([(["https://a.example/x", "https://meet.calendly.com/b"],), (["https://a.example/book/1"],), ([],), (None,)], "u array<string>")
    got = [r.s for r in df.select(fields.scheduling_url(F.col("u")).alias("s")).collect()]
    assert got == ["https://meet.calendly.com/b", "https://a.example/book/1", "", ""]


def test_jsonld_values():
    assert html.pay_range({"baseSalary": [{"currency": "EUR", "value": {"value": 40, "unitText": "HOUR"}}]}) == "EUR 40 /hour"
    assert html.pay_range({"estimatedSalary": {"value": 7}}) == "USD 7" and html.pay_range({"baseSalary": "x"}) == "" and html.pay_range({}) == ""
    assert html.posted_day({"datePosted": "20240506"}) == "2024-05-06" and html.posted_day({"dateCreated": "soon"}) == "soon" and html.posted_day({}) == ""
    assert html.employment_kind({"employmentType": ["PART_TIME"]}) == "Part-Time" and html.employment_kind({"employmentType": "per_diem"}) == "Per Diem"


def test_letters_without_anything_told(spark):
    df = spark.createDataFrame([(None, None, None, None), ("Re: hello", "x" * 50_000, "", "")], "s string, b string, n string, a string")
    got = [r.t for r in df.select(roles.told(*map(F.col, "sbna")).alias("t")).collect()]
    assert [(t.company, t.role) for t in got] == [("", ""), ("", "")]
