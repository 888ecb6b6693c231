"""Streams give what the batch operators give, also after a stop and a restart."""

import pytest
from pyspark.sql import functions as F

from skygauge.functions.grading import core_missing, with_grades
from skygauge.functions.scalars import zoned_instant
from skygauge.operators.gate import send_gate
from skygauge.operators.validate import valid_messages, validate
from skygauge.plans import views
from skygauge.sources import tables
from skygauge.sources.topic import RECORD_SCHEMA, publish_records, read_record_files
from skygauge.streaming.alerts import AlertStream, first_copy_only
from skygauge.streaming.stateful import gate_stream
from tests.conftest import SF_SMALL

HISTORY = "event_id string, region string, timestamp string, offset bigint, severity string, grade_signature string, delivered_channels array<string>, recorded boolean"


@pytest.fixture(scope="module")
def record_files(spark, tmp_path_factory):
    """Topic records in four files of rising offsets, as a broker would deliver them."""
    path = str(tmp_path_factory.mktemp("records"))
    raw = views.raw_records(spark, SF_SMALL).drop("ts").cache()
    edges = raw.selectExpr("percentile_approx(offset, array(0.25, 0.5, 0.75)) p").head().p
    bounds = [-1, *edges, 10**12]
    for low, high in zip(bounds, bounds[1:]):
        part = raw.where((F.col("offset") > low) & (F.col("offset") <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def expected(spark, path):
    records = spark.read.schema(RECORD_SCHEMA).parquet(path)
    messages = valid_messages(validate(records))
    rows = with_grades(messages).select(
        "region", "offset", "event_id",
        zoned_instant(F.col("timestamp")).alias("clock"),
        F.when(F.col("pm10").isNull(), "U").when(F.col("pm10") <= 80, "L").otherwise("H").alias("signature"),
        F.expr(core_missing()).alias("core_missing"),
        (F.col("offset") % 5 != 0).alias("delivered"),
        F.lit(True).alias("enabled"),
    )
    return rows


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_alert_stream_with_restart_equals_batch(spark, record_files, tmp_path):
    outcomes = lambda m: m.select(
        "event_id", F.lit("slack").alias("channel"), (F.col("offset") % 5 != 0).alias("ok")
    )
    stream = AlertStream(str(tmp_path / "out"), outcomes=outcomes)
    checkpoint = str(tmp_path / "ckpt")

    class Stopped(Exception):
        pass

    def stop_after_two(batch, number):
        if number == 2:
            raise Stopped
        stream.process(batch, number)

    source = read_record_files(spark, record_files, max_files=1)
    first = source.writeStream.foreachBatch(stop_after_two).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        first.awaitTermination()
    stream.start(read_record_files(spark, record_files, max_files=1), checkpoint).awaitTermination()

    messages = valid_messages(validate(spark.read.schema(RECORD_SCHEMA).parquet(record_files)))
    graded = stream._graded(messages)
    rows = graded.select(
        "region", "offset", "event_id", "clock", "signature", "core_missing",
        (F.col("offset") % 5 != 0).alias("delivered"), F.lit(True).alias("enabled"),
    )
    want = send_gate(rows)
    history = tables.read_history(spark, stream.path("history"), HISTORY)
    assert as_set(history, "event_id", "offset", "recorded") == as_set(want, "event_id", "offset", "recorded")
    outbox = spark.read.parquet(stream.path("outbox"))
    assert as_set(outbox, "event_id") == as_set(want.where("send"), "event_id")
    assert outbox.count() == 3 * want.where("send").count()
    metrics = spark.read.parquet(stream.path("metrics"))
    assert metrics.count() == messages.count()
    assert metrics.where("process_duration_ms > 0").count() == messages.count()  # never null
    dead = spark.read.parquet(stream.path("dead_letters"))
    assert dead.count() + messages.count() == spark.read.parquet(record_files).count()
    assert dead.where("reason is null").count() == 0


def test_batch_number_replay_changes_nothing(spark, record_files, tmp_path):
    stream = AlertStream(str(tmp_path / "out"))
    records = spark.read.schema(RECORD_SCHEMA).parquet(record_files)
    half = records.agg(F.percentile_approx("offset", 0.5)).head()[0]
    parts = [records.where(F.col("offset") <= half), records.where(F.col("offset") > half)]
    for number, part in enumerate(parts):
        stream.process(part, number)
    history = as_set(tables.read_history(spark, stream.path("history"), HISTORY), "event_id", "offset", "grade_signature")
    outbox = spark.read.parquet(stream.path("outbox")).count()
    stream.process(parts[1], 1)
    assert as_set(tables.read_history(spark, stream.path("history"), HISTORY), "event_id", "offset", "grade_signature") == history
    assert spark.read.parquet(stream.path("outbox")).count() == outbox
    target = str(tmp_path / "compacted")
    tables.compact_history(spark, stream.path("history"), target, HISTORY)
    assert as_set(tables.read_history(spark, target, HISTORY), "event_id", "offset", "grade_signature") == history


def test_stateful_gate_with_restart_equals_batch(spark, record_files, tmp_path):
    source = str(tmp_path / "rows")
    rows = expected(spark, record_files).cache()
    middle = rows.agg(F.percentile_approx("offset", 0.5)).head()[0]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for part in (rows.where(F.col("offset") <= middle), rows.where(F.col("offset") > middle)):
        part.repartition(1).write.mode("append").parquet(source)
        stream = gate_stream(spark.readStream.schema(rows.schema).parquet(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
    got = as_set(spark.read.parquet(out), "event_id", "send", "recorded")
    assert got == as_set(send_gate(rows), "event_id", "send", "recorded")


def test_first_copy_only_bounds_state(spark, tmp_path):
    source = str(tmp_path / "m")
    spark.sql(
        "select * from values ('e1', timestamp'2026-01-01 00:00:00'), ('e1', timestamp'2026-01-01 00:10:00'), ('e2', timestamp'2026-01-01 00:20:00') t(event_id, at)"
    ).write.parquet(source)
    stream = first_copy_only(spark.readStream.schema("event_id string, at timestamp").parquet(source), "at", "1 hour")
    query = stream.writeStream.format("memory").queryName("copies").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("copies").collect()) == ["e1", "e2"]


def test_published_records_validate_again(spark):
    m = views.messages(spark, SF_SMALL).drop("ts", "slot", "msg_offset", "msg_partition").withColumn("schema_version", F.lit(1))
    records = publish_records(m).withColumns(
        {"topic": F.lit("t"), "partition": F.lit(0), "offset": F.monotonically_increasing_id()}
    )
    back = valid_messages(validate(records.select("topic", "partition", "offset", "key", "value")))
    assert as_set(back, "event_id", "pm10", "yellow_dust") == as_set(m, "event_id", "pm10", "yellow_dust")


def _sizes(spark, stream):
    names = ("history", "outbox", "metrics", "dead_letters")
    return {n: as_set(spark.read.parquet(stream.path(n)), *(("event_id",) if n != "dead_letters" else ("raw",))) for n in names}


def test_new_checkpoint_keeps_earlier_output_and_state(spark, record_files, tmp_path):
    """A second stream with a new checkpoint on the same folder adds to it and decides as if the first had gone on."""
    records = spark.read.schema(RECORD_SCHEMA).parquet(record_files)
    half = records.agg(F.percentile_approx("offset", 0.5)).head()[0]
    parts = [records.where(F.col("offset") <= half), records.where(F.col("offset") > half)]
    whole, cut = AlertStream(str(tmp_path / "whole")), AlertStream(str(tmp_path / "cut"))
    for number, part in enumerate(parts):
        whole.process(part, number)
    seen = {}
    for number, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{number}"))
        cut.start(read_record_files(spark, str(tmp_path / f"in{number}")), str(tmp_path / f"ckpt{number}")).awaitTermination()
        now = _sizes(spark, cut)
        assert all(seen[n] <= now[n] for n in seen)
        seen = now
    assert seen == _sizes(spark, whole)
    for name in ("history", "outbox", "metrics", "dead_letters"):
        assert spark.read.parquet(cut.path(name)).count() == spark.read.parquet(whole.path(name)).count()
    decisions = ("event_id", "recorded", "grade_signature")
    assert as_set(tables.read_history(spark, cut.path("history"), HISTORY), *decisions) == as_set(
        tables.read_history(spark, whole.path("history"), HISTORY), *decisions
    )


def test_same_offset_in_two_partitions_gives_one_row_a_message(spark, record_files, tmp_path):
    records = spark.read.schema(RECORD_SCHEMA).parquet(record_files)
    stream = AlertStream(str(tmp_path / "out"))
    valid = stream._graded(valid_messages(validate(records))).where("not core_missing").select("partition", "offset").head()
    one = records.where((F.col("offset") == valid.offset) & (F.col("partition") == valid.partition))
    both = one.unionAll(one.withColumn("partition", F.col("partition") + 1))
    stream.process(both, 0)
    assert spark.read.parquet(stream.path("history")).count() == 2
    assert spark.read.parquet(stream.path("metrics")).count() == 2
    assert spark.read.parquet(stream.path("outbox")).count() == 3  # the second one repeats the signature


def test_replayed_batch_keeps_its_time(spark, tmp_path):
    first, again = (
        spark.range(1).select(tables.batch_time(spark, str(tmp_path / "b"), 4).alias("t")).head().t for _ in range(2)
    )
    assert first == again
