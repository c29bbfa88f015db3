import pytest
from pyspark.sql import functions as F

from missive.functions import digest
from missive.operators import extract

CARDS = """<html><head><style>x</style></head><body><table><tr><td>
<a href="https://www.linkedin.com/comm/jobs/view/5566778899/?t=1">Nurse Scheduler</a><p>Orrin Labs · Oslo, NY</p><p><a href="https://linkedin.com/jobs/view/5566778899">View job</a></p>
</td></tr><tr><td><a href="https://de.indeed.com/viewjob?jk=aa11bb22">Data Analyst</a><br>Tarn Group<br>$90,000 a year<br>Remote</td></tr>
<tr><td><a href="https://zeta.example/careers/role-88123"><b>Senior</b> Backend Developer</a></td></tr></table>
<table><tr><td>Machine Learning Engineer</td></tr><tr><td>Velden Inc</td></tr><tr><td>Boston</td></tr></table>
<a href="https://linkedin.com/jobs/search?q=a">See all jobs</a><a href="https://zeta.example/unsubscribe">Unsubscribe</a><p><b>open"""


def titles(markup, plain="", name="Zeta Careers", address="jobs@zeta.example", subject="", most=40):
    return [(x["url_key"], x["title"], x["company"], x["location"]) for x in digest.postings(markup, plain, name, address, subject, most)]


def test_cards_lines_and_unlinked_tables():
    assert titles(CARDS) == [
        ("linkedin:5566778899", "Nurse Scheduler", "Orrin Labs", "Oslo, NY"),
        ("indeed:aa11bb22", "Data Analyst", "Tarn Group", "Remote"),
        ("zeta.example:zeta.example/careers/role-88123", "Senior Backend Developer", "Zeta", ""),
        ("card:velden inc:machine learning engineer", "Machine Learning Engineer", "Velden Inc", "Boston"),
    ]
    assert len(titles(CARDS, most=2)) == 2


def test_better_titles_win_and_nothing_raises():
    link = '<p><a href="https://linkedin.com/jobs/view/55667788">{}</a></p>'
    assert [t for _, t, *_ in titles(link.format("Requisition 77") + link.format("Data Analyst"))] == ["Data Analyst"]
    assert [t for _, t, *_ in titles(link.format("Data Analyst") + link.format("Lead Data Analyst"))] == ["Lead Data Analyst"]
    assert titles(None) == [] and titles("") == [] and titles("<a href='http://[x'>Data Analyst</a><table><b></table></p>") == []
    assert titles("<a href='https://linkedin.com/jobs/view/1234567'>View job</a>") == []


def test_plain_text_only_if_there_is_no_card():
    text = "See https://linkedin.com/jobs/view/5566778899, and https://zeta.example/news."
    assert titles("", text) == [("linkedin:5566778899", "", "Zeta", "")]


@pytest.mark.parametrize(
    "name, address, subject, company",
    [
        ("Careers at Orrin Labs", "", "", "Orrin Labs"), ("Orrin Jobs", "", "", "Orrin"), ("LinkedIn Jobs", "x@linkedin.com", "", "X"),
        ("x", "a@b", "New jobs posted from orrin.jobs2web.com", "Orrin"), ("x", "a@b", "Job alerts for you from Tarn", "Tarn"),
        ("x", "a@b", "Clerk at Tarn.", "Tarn"), ("x", "a@b", "Clerk @ Tarn", "Tarn"), ("x", "orrin.labs@b", "", "Orrin Labs"), ("Tarn", "noreply@b", "", "Tarn"),
        ("Indeed", "alerts@indeed.com", "", ""), ("", "", "", ""),
    ],
)
def test_sender_company(name, address, subject, company):
    assert digest.sender_company(name, address, subject) == company


def test_gates_and_grounding(spark):
    mails = spark.createDataFrame([("m", CARDS, "Data Analyst\nActuary at work\nClerk"), ("n", None, None), ("o", "", "")], "id string, html string, plain string")
    links = extract.anchors(mails, "id", "html")
    assert [(r.idx, r.label) for r in links.where("is_posting").orderBy("idx").collect()][0] == (0, "Nurse Scheduler")
    assert links.where("label = 'Unsubscribe'").count() == 0 and links.where("id <> 'm'").count() == 0
    expected = extract.expected_postings(links, mails, "id", "plain")
    found = spark.createDataFrame([("m", "linkedin:5566778899")], "id string, url_key string")
    got = {r.id: r for r in extract.incomplete(found, links, expected, "id").collect()}
    assert got["m"].expected >= 2 and got["m"].unclaimed == 2 and got["m"].asks
    rows = [("m", 0, 0, "Nurse Scheduler", "Orrin", ""), ("m", 1, 0, "Ward Clerk", "", ""), ("m", 2, 999, "Invented", "", ""), ("m", 3, None, "Cook", "Tarn", "Oslo"),
            ("m", 4, 0, "View job", "", ""), ("m", 5, None, "Cook", "Tarn", "Rome"), ("m", 6, None, None, None, None)]
    recovered = spark.createDataFrame(rows, "id string, pos long, link int, title string, company string, location string")
    got = sorted((r.url_key, r.title, r.location) for r in extract.grounded(recovered, links, "id").collect())
    assert got == [("card:tarn:cook", "Cook", "Oslo"), ("linkedin:5566778899", "Nurse Scheduler", ""), ("linkedin:5566778899#ward clerk", "Ward Clerk", "")]


def test_asks_again(spark):
    df = spark.createDataFrame([(5, 2), (4, 2), (9, 0)], "e long, n long")
    assert [r.x for r in df.select(extract.asks_again(F.col("e"), F.col("n")).alias("x")).collect()] == [True, False, False]
