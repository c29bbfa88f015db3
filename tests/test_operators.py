from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from missive.operators import dedup, fold, reports, score
from missive.streaming import pipeline

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_with_root_ties_nulls_and_blank_keys(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "", 1), (4, None, 1), (5, "b", 1)], "id long, k string, t int")
    got = {r.id: r.root_id for r in dedup.with_root(rows, F.col("k"), ["t", "id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_with_root_of_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = dedup.with_root(rows, F.col("k"), ["id"])
    assert got.where("k = 'hot' AND root_id = 0").count() == 1000 and got.count() == 3000


def test_throttle_is_greedy(spark):
    rows = spark.createDataFrame([(i, "u", at(m)) for i, m in enumerate([0, 6, 11, 12, 25, 60])], "id long, u string, t timestamp")
    kept = {r.id for r in dedup.throttle(rows, ["u"], "t", 600, "id").collect()}
    assert kept == {0, 2, 4, 5}


def test_suppress_repeats_is_ordered(spark):
    rows = spark.createDataFrame([(1, "m", "T", None), (2, "m", "t", "Acme"), (3, "m", "T", ""), (4, "n", "T", "")], "id long, g string, title string, c string")
    got = {r.id for r in dedup.suppress_repeats(rows, "g", F.col("title"), F.col("c"), ["id"]).collect()}
    assert got == {1, 2, 4}


def test_pointers_over_days_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(0)), (3, "a", at(3000)), (4, "a", None), (5, "b", at(9))], "id long, k string, t timestamp")
    got = {r.id: (r.root_id, r.seq) for r in dedup.pointers(rows, "k", ["t", "id"]).collect()}
    assert got == {4: (4, 0), 1: (4, 1), 2: (4, 2), 3: (4, 3), 5: (5, 0)}
    assert dedup.pointers(rows.where("false"), "k", ["t", "id"]).count() == 0


def test_throttle_against_brute_force(spark):
    import random

    random.seed(3)
    data = [(i, random.choice(["a", "b", None]), at(random.randint(0, 3000) / 7)) for i in range(3000)]
    rows = spark.createDataFrame(data, "id long, u string, t timestamp")
    want, last = set(), {}
    for i, u, t in sorted(data, key=lambda x: (x[2], x[0])):
        if u not in last or (t - last[u]).total_seconds() >= 600:
            want.add(i)
            last[u] = t
    assert {r.id for r in dedup.throttle(rows, ["u"], "t", 600, "id").collect()} == want
    assert dedup.throttle(rows.where("false"), ["u"], "t", 600, "id").count() == 0


RANKS = {"applied": 1, "interview": 2, "rejected": 3}


def test_fold_never_regresses(spark):
    events = spark.createDataFrame([("a", "applied", 1), ("a", "interview", 2), ("a", "applied", 3), ("b", "rejected", 1), ("b", "interview", 9)], "e string, k string, n int")
    got = {r.e: (r.status, r.closed, r.n_events) for r in fold.fold_status(events, "e", "k", ["n"], RANKS, {"rejected"}).collect()}
    assert got == {"a": ("interview", False, 3), "b": ("rejected", True, 2)}


def test_fold_of_nothing(spark):
    empty = spark.createDataFrame([], "e string, k string, n int")
    assert fold.fold_status(empty, "e", "k", ["n"], RANKS, set()).count() == 0


def test_attach_in_tiers(spark):
    rows = [(1, "acme", "data engineer", 5, False), (2, "acme", "analyst", 1, False), (3, "acme", "clerk", 9, True), (4, "acme labs", "x", 3, True),
            (5, "acme labs", "y", 2, True), (6, "", "x", 1, False)]
    entities = spark.createDataFrame([(i, c, r, at(t), x) for i, c, r, t, x in rows], "entity_id long, company string, role string, last_event_at timestamp, closed boolean")
    asked = [(10, "acme", "analyst", True), (11, "acme", "senior data engineer", True), (12, "acme labs berlin", "", False), (13, "other", "", False), (14, "", "x", True),
             (15, "acme", "driver", True), (16, "acme labs berlin", "y", True)]
    events = spark.createDataFrame(asked, "event_id long, company string, role string, has_role boolean")
    got = {r.event_id: (r.entity_id, r.tier, r.prefix) for r in fold.attach(events, entities).collect()}
    # 12: both prefixes of it count, so the newest open one is of the shorter name.
    assert got == {10: (2, 0, False), 11: (1, 1, False), 12: (1, 2, True), 15: (1, 2, False), 16: (5, 1, True)}
    assert fold.attach(events.where("false"), entities).count() == 0 and fold.attach(events, entities.where("false")).count() == 0


def test_attach_of_a_hot_company(spark):
    events = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("acme").alias("company"), F.lit("").alias("role"), F.lit(False).alias("has_role"))
    entities = spark.range(2000).select(
        F.col("id").alias("entity_id"), F.lit("acme").alias("company"), F.lit("x").alias("role"), F.timestamp_seconds("id").alias("last_event_at"), F.lit(False).alias("closed")
    )
    assert {(r.entity_id, r.tier) for r in fold.attach(events, entities).collect()} == {(1999, 2)}


def test_zero_filled_keeps_unknown_labels(spark):
    rows = spark.createDataFrame([("x",), ("x",), ("new",)], "c string")
    got = {r.label: (r.n, r.position) for r in reports.zero_filled(rows, "c", ["x", "y"]).collect()}
    assert got == {"x": (2, 0), "y": (0, 1), "new": (1, 2)}


def test_runs_follow_the_list(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a"), (6, "b")], "at long, l string")
    got = [(r.at, r.run) for r in reports.run_groups(rows, F.col("l"), [F.asc("at")]).orderBy("at").collect()]
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4)]
    assert reports.run_groups(rows.where("false"), F.col("l"), [F.asc("at")]).count() == 0


def test_rollup_levels(spark):
    rows = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "a string, b string")
    got = {(r.a, r.b, r.level): r.n for r in reports.rollup(rows, "a", "b").collect()}
    assert got[(None, None, 3)] == 3 and got[("a", None, 1)] == 2 and got[(None, "p", 2)] == 2 and got[("a", "p", 0)] == 1


def scored(spark, rows, profile=score.EXAMPLE):
    df = spark.createDataFrame(rows, "title string, description string, location string, company string")
    return score.matched(df, profile, "title", "description", "location", "company").collect()


def test_match_bounds_and_nulls(spark):
    got = scored(spark, [("Data Engineer", "python sql spark machine learning aws docker r " * 50, "Velden", "x"), (None, None, None, None), ("Clerk", "nothing", "", "")])
    assert 0.7 < got[0].score <= 1 and got[0].matched and got[0].missing_skills == ""
    assert got[1].score == pytest.approx(0.04) and not got[1].matched and got[2].score < 0.1


def test_match_rejects_and_takes_off(spark):
    text = "python sql spark, 12+ years of experience"
    rows = [("Sales Manager", text, "", ""), ("Data Engineer", "unpaid " + text, "", ""), ("Data Engineer", text + ". No sponsorship.", "", ""),
            ("Data Engineer", text, "Velden", ""), ("Data Engineer", "python sql spark", "Velden", ""), ("Data Engineer", "python sql spark", "Nowhere", ""),
            ("Data Management Analyst", "sql", "", "")]
    got = scored(spark, rows)
    assert [r.verdict for r in got[:3]] == ["rejected: excluded title", "rejected: contains 'unpaid'", "rejected: no sponsorship"]
    assert [r.score for r in got[:3]] == [0, 0, 0] and all(r.title_score == 0 for r in got[:3])
    assert "wants 12y" in got[3].verdict and got[4].score - got[5].score == pytest.approx(0.1) and got[4].score > got[3].score + 0.1
    assert not got[6].rejected


def test_title_hits_in_any_order_and_folded(spark):
    p = score.Profile(text="sql", skills=(("sql", 1.0, ()),), titles=("ml engineer",), title_words=("data", "ml"))
    df = spark.createDataFrame([("Engineer, Machine Learning",), ("Machine Learning Engineer II",), ("Data and ML lead",), ("Data lead",), ("Intern, Data",), (" ",), (None,)], "t string")
    rows = score.with_title_score(df, "t", p)
    got = [(r.title_score, r.w) for r in rows.select("title_score", score.worth_reading(rows, "t").alias("w")).collect()]
    assert got == [(1.0, True), (1.0, True), (0.75, True), (0.5, True), (0.5, False), (0.35, False), (0.35, False)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, at(i)) for i in range(60)], "id long, t timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = pipeline.drain(pipeline.deduplicated(stream, "id", "t", "2 hours"), str(tmp_path / "out"), "append")
    assert got.count() == 7


def test_idempotent_sink(spark, tmp_path):
    write = pipeline.idempotent_sink(str(tmp_path / "t"), "id")
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(3, "c")], "id long, v string"), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
