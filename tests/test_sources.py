import json
from datetime import datetime

from pyspark.sql import functions as F

from missive.operators import extract
from missive.sources import mailbox, sinks

T0 = datetime(2024, 1, 1)


def test_mailbox_source_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1", "payload": {"headers": []}}) + "\n{bad\n")
    mailbox.register(spark)
    rows = spark.read.format("mailbox").load(str(tmp_path)).collect()
    assert [r.id for r in rows] == ["1"] and json.loads(rows[0].payload) == {"headers": []}


def test_push_envelope(spark):
    df = spark.createDataFrame([("eyJhIjogMX0=",), ("???",), (None,)], "d string")
    assert [r.p and r.p.a for r in df.select(mailbox.decode_push(F.col("d"), "a int").alias("p")).collect()] == [1, None, None]


def test_reports_fold_to_one_row(spark, tmp_path):
    rows = [("m", "first", "ui", "p1", T0), ("m", "second", "api", "p2", T0.replace(hour=1)), ("n", None, "ui", "p", T0)]
    sinks.append_reports(spark.createDataFrame(rows, "id string, note string, source string, payload string, reported_at timestamp"), str(tmp_path / "log"))
    got = {r.id: r for r in sinks.fold_reports(spark.read.parquet(str(tmp_path / "log")), "id").collect()}
    assert got["m"].report_count == 2 and got["m"].notes == "first\nsecond" and got["m"].payload == "p2" and got["n"].notes == ""


def test_merge_fills_blanks_only(spark):
    rules = spark.createDataFrame([("m", "k1", "", "Austin")], "id string, key string, company string, place string")
    other = spark.createDataFrame([("m", "k1", "Acme", "Paris"), ("m", "k2", "Bcme", None)], "id string, key string, company string, place string")
    got = sorted((r.key, r.company, r.place, r.by_rules) for r in extract.merge_recovered(rules, other, ["id", "key"], ["company", "place"]).collect())
    assert got == [("k1", "Acme", "Austin", True), ("k2", "Bcme", "", False)]
