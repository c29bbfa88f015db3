import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from missive.functions import boards, times
from missive.functions import text as T
from missive.operators import facets
from missive.sources import profiles

NOW = datetime(2025, 3, 10, 12, tzinfo=timezone.utc)


def test_window_bounds():
    start, end = times.window_bounds(7, NOW, "2025-03-05", "2025-03-01")
    assert (start.day, end.day) == (1, 6)
    start, end = times.window_bounds(0, NOW)
    assert (end - start).days == 1
    assert times.window_bounds(3, NOW, "bad", None) == (NOW.replace(day=7), NOW)


def test_next_tick_counts_from_the_origin():
    origin = 18 * 3600 + 180
    assert times.next_tick(origin, origin, 900) == (origin, origin + 900)
    origin = 17 * 3600 + 48 * 60
    assert times.next_tick(origin, 18 * 3600 + 240, 900) == (17 * 3600 + 48 * 60, 18 * 3600 + 180)
    assert times.next_tick(origin, origin + 10, 5) == (origin, origin + 60)


def test_parse_local_crosses_daylight_saving(spark):
    df = spark.createDataFrame([("2025-03-09 01:30",), ("2025-03-09T03:30",), ("2025-07-01",), ("x",), (None,)], "t string")
    got = [r.s for r in df.select(F.unix_seconds(times.parse_local(F.col("t"))).alias("s")).collect()]
    assert got[1] - got[0] == 3600 and got[2] == int(datetime(2025, 7, 1, 4, tzinfo=timezone.utc).timestamp()) and got[3:] == [None, None]


def test_boards_and_links(spark):
    lever = json.dumps({"text": "NLP Engineer", "categories": {"location": "Austin"}, "description": "<p>Hi &amp; bye</p>", "createdAt": 1714521600000})
    df = spark.createDataFrame([("lever", lever), ("lever", "{"), ("other", "{}")], "b string, j string")
    rows = df.select(boards.board_fields(F.col("b"), F.col("j")).alias("f")).collect()
    assert rows[0].f.title == "NLP Engineer" and rows[0].f.description == "Hi & bye" and rows[0].f.posted_at == "2024-05-01"
    assert rows[1].f.title == "" and rows[2].f is None
    links = spark.createDataFrame([([("https://x.example/a", ""), ("https://www.cal.example/b", "")],), ([],)], "l array<struct<url string, text string>>")
    assert [r.u for r in links.select(boards.first_link(F.col("l"), ["cal.example"]).alias("u")).collect()] == ["https://www.cal.example/b", ""]


def test_facets_and_unique(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "id long, v string")
    assert facets.unique_by_id(rows).count() == 3
    empty = spark.createDataFrame([], "id string, message_id string, category string, jobs_found long")
    mails = spark.createDataFrame([("m", "other", 2)], "id string, category string, jobs_found long")
    assert facets.facet(mails, empty, empty, "unstored").count() == 1 and facets.facet(mails, empty, empty, "jobs").count() == 0


def test_profile_from_json(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"resume_text": "sql", "skills": [{"name": "SQL", "weight": 3, "aliases": ["Postgres"]}], "target_titles": ["Data Engineer"]}))
    got = profiles.load_profile(str(path))
    assert got.skills == (("sql", 3.0, ("postgres",)),) and got.titles == ("data engineer",) and got.remote_ok and got.places == ()
    path.write_text(json.dumps({"exclude_titles": ["VP"], "preferred_locations": ["Oslo"], "remote_ok": False, "max_years_experience": 3, "job_alert_senders": ["A@b"]}))
    got = profiles.load_profile(str(path))
    assert (got.excluded_titles, got.places, got.remote_ok, got.most_years, got.senders) == (("vp",), ("oslo",), False, 3, ("a@b",))


def test_clearing_windows():
    at = lambda day, hour, minute=0: datetime(2025, 3, day, hour, minute, tzinfo=timezone.utc)
    assert times.clearing_window(NOW) == (at(10, 4), NOW)
    assert times.clearing_window(NOW, start="2025-03-08T10:00", end="2025-03-08T12:30") == (at(8, 15), at(8, 17, 31))
    assert times.clearing_window(NOW, start="2025-03-08T12:00", end="2025-03-08T10:00") == (at(8, 15, 1), at(8, 17))
    assert times.clearing_window(NOW, start="2025-03-08T10:00", end="x", hours=2) == (at(8, 15), at(8, 17))
    assert times.clearing_window(NOW, at(1, 0), "old") == (at(1, 0), NOW) and times.clearing_window(NOW, None, "old") == (NOW, NOW + (at(1, 0, 1) - at(1, 0)))


def test_labels_and_replies(spark):
    df = spark.createDataFrame([("next_step", 'Sure: {"a": {"b": 1}} done'), ("offer", "{bad}"), (None, "[1]"), ("x", None)], "k string, r string")
    rows = df.select(T.label_of(F.col("k"), {"offer": "Offers"}, {"offer": "*"}).alias("l"), T.reply_object(F.col("r")).alias("o")).collect()
    assert [r.l for r in rows] == ["Next Step", "* Offers", "", "X"] and [r.o for r in rows] == ['{"a":{"b":1}}', None, None, None]
    ages = spark.createDataFrame([(0,), (89,), (3599,), (7200,), (200_000,), (None,)], "s long").select(
        times.ago(F.timestamp_seconds(F.lit(1_000_000) - F.col("s")), F.timestamp_seconds(F.lit(1_000_000))).alias("a")
    )
    assert [r.a for r in ages.collect()] == ["just now", "just now", "59m ago", "2h ago", "2d ago", "never"]
    one = spark.createDataFrame([(1_710_000_000,)], "s long").select(times.clock_label(F.timestamp_seconds("s")).alias("c")).first()
    assert one.c == "Mar 09, 11:00 AM ET"
