import json
from datetime import datetime, timedelta

from missive.sources import mailbox, store
from missive.streaming import cursor

T0 = datetime(2024, 1, 1)


def test_batches_replace_themselves(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    schema = "id long, v string"
    assert s.read("job", schema).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    for batch in (0, 0, 1):
        s.append("job", rows, batch)
    assert s.read("job", schema + ", later int").count() == 4 and s.read("job", schema + ", later int").where("later IS NOT NULL").count() == 0
    s.replace("job", s.read("job", schema).where("id = 1"), "kept")
    assert [r.id for r in s.read("job", schema).collect()] == [1, 1]
    s.append("state", rows, 0)
    s.clear("none", {"job": schema, "state": schema})
    assert s.read("job", schema).count() == 0 and s.read("state", schema).count() == 2


def test_actions_win_by_time_and_null_is_a_value(spark):
    rows = spark.createDataFrame([(1, "new", True), (2, "new", False), (3, None, None)], "id long, status string, handled boolean")
    log = [("job", "1", "status", "saved", T0), ("job", "1", "status", "ignored", T0 + timedelta(1)), ("job", "2", "handled", "true", T0), ("mail", "3", "status", "x", T0),
           ("job", "1", "handled", None, T0)]
    actions = spark.createDataFrame(log, store.ACTION)
    got = {r.id: (r.status, r.handled) for r in store.acted(rows, actions, "job", "id", ["status", "handled"]).collect()}
    assert got == {1: ("ignored", None), 2: ("new", True), 3: (None, None)}
    assert store.acted(rows, actions.where("false"), "job", "id", ["status"]).count() == 3


def test_exports_and_record_files(spark, tmp_path):
    rows = [("a/b", '{"x": 1}', T0), ("c", "{bad", T0 + timedelta(1)), ("d", None, T0), ("e", "[1]", T0 + timedelta(2))]
    df = spark.createDataFrame(rows, "id string, payload string, at timestamp")
    store.export_lines(df, "payload", "id", "at", str(tmp_path / "lines"), most=3)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert {"message_id": "e", "payload": "[1]"} in lines and {"message_id": "c", "payload": "{bad"} in lines and {"message_id": "d"} in lines and len(lines) == 3
    store.record_files(df, "payload", "id", str(tmp_path / "records"))
    assert json.loads((tmp_path / "records" / "a_b.json").read_text()) == {"x": 1} and (tmp_path / "records" / "d.json").exists()
    assert spark.read.json(str(tmp_path / "records" / "_index")).count() == 4


def test_cursor_rules():
    assert cursor.read_bounds(None, 100, 500) == (100, 500) and cursor.read_bounds(1000, 100, 1500) == (700, 1500) and cursor.read_bounds(350, 100, 90) == (100, 100)
    assert cursor.exclusive_after(100) == 99
    assert cursor.committed(5, 9, 7, True) == 5 and cursor.committed(5, 9, 7, False) == 9 and cursor.committed(5, None, 7, False) == 7
    assert cursor.committed(5, None, None, False) == 5 and cursor.committed(None, None, 3, False) == 3 and cursor.committed(9, 5, None, False) == 9


def test_mailbox_streams_files_and_counts_runs(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n{bad\n')
    mailbox.register(spark)
    stream = spark.readStream.format("mailbox").load(str(box))

    def run():
        q = stream.select("id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        q.awaitTermination()
        return q

    q = run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
    assert cursor.run_metrics(spark, q).count() >= 1
    (box / "b.jsonl").write_text('{"id": "3"}\n')
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]
