import datetime as dt
import json

from pyspark.sql import functions as F

from skygauge.operators import ingest, monitor
from skygauge.sources import logs, payloads, tables, topic


def test_payload_files_and_tables(spark, tmp_path):
    folder = tmp_path / "replies" / "source=uv" / "region=seoul"
    folder.mkdir(parents=True)
    reply = {"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": [{"h0": "1"}, {"h0": "2"}]}}}}
    (folder / "a.json").write_text(json.dumps(reply, indent=1))
    files = payloads.read_payload_files(spark, str(tmp_path / "replies"))
    row = files.head()
    assert (row.source, row.region, row.status_code) == ("uv", "seoul", 200) and row.fetched_at is not None
    items = ingest.explode_items(ingest.parse_payloads(files), ["source"]).orderBy("ord").collect()
    assert [r.item for r in items] == [{"h0": "1"}, {"h0": "2"}]
    path = str(tmp_path / "table")
    files.write.parquet(path)
    assert payloads.read_payload_table(spark, path).count() == 1


def test_log_file(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("INFO api_call api=x status=200 duration_ms=12\nother\nWARN api_call api=x status=EXC duration_ms=30\n")
    got = monitor.api_call_stats(monitor.api_calls(logs.read_log_lines(spark, str(path)))).head()
    assert (got.api, got.n, got.p50, got.p95) == ("x", 2, 21.0, 30.0)


def test_record_stream_to_files(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, 1, bytearray(b"r"), bytearray(b"{}"))], topic.RECORD_SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = topic.read_record_files(spark, str(tmp_path / "in"))
    topic.stream_to_files(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).collect() == rows.collect()


def test_history_months_batches_and_replay(spark, tmp_path):
    path = str(tmp_path / "history")
    schema = "event_id string, timestamp string, offset bigint, v string"

    def rows(*r):
        return spark.createDataFrame(list(r), schema)

    tables.write_history(rows(("e1", "2026-07-31T23:30:00+09:00", 1, "old"), ("e2", "2026-08-01T00:30:00+09:00", 2, "x")), path, 0)
    for _ in range(2):
        tables.write_history(rows(("e1", "2026-07-31T23:30:00+09:00", 5, "new")), path, 1)
    got = {(r.month, r.event_id, r.v) for r in tables.read_history(spark, path, schema).collect()}
    assert got == {("2026.07", "e1", "new"), ("2026.08", "e2", "x")}
    pruned = spark.read.parquet(path).where("month = '2026.08'")
    assert "PartitionFilters: [isnotnull(month" in pruned._jdf.queryExecution().executedPlan().toString()


def test_state_slots_alternate(spark, tmp_path):
    path = str(tmp_path / "state")
    at = dt.datetime(2026, 7, 1)
    frame = lambda s: spark.createDataFrame([("r", s, at)], tables.STATE_SCHEMA)
    assert tables.read_state(spark, path, 0).isEmpty()
    for number, sig in enumerate("abc"):
        tables.write_state(frame(sig), path, number)
    assert tables.read_state(spark, path, 3).head().signature == "c"
    assert tables.read_state(spark, path, 2).head().signature == "b"


def test_checkpoint_folder_comes_from_the_session(spark):
    from skygauge.operators.ordered import cut_lineage

    named = spark.conf.get("spark.checkpoint.dir")
    cut = cut_lineage(spark.range(5))
    assert cut.count() == 5
    used = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert named.removeprefix("file:") in used


def test_metric_and_dead_letter_batches_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("e1", dt.datetime(2026, 7, 1))], "event_id string, processed_at timestamp")
    for _ in range(2):
        tables.write_metrics(rows, str(tmp_path / "m"), 4)
        tables.write_batch(rows.withColumn("reason", F.lit("x")), str(tmp_path / "d"), 4)
    assert spark.read.parquet(str(tmp_path / "m")).count() == spark.read.parquet(str(tmp_path / "d")).count() == 1
