import datetime as dt

from pyspark.sql import functions as F

from skygauge.operators import delivery as d
from skygauge.operators.gate import recorded

T = dt.datetime(2026, 7, 30, 12)


def test_record_decision(spark):
    cases = {(True, True, True): True, (True, True, False): False, (False, True, False): True, (True, False, False): True}
    df = spark.createDataFrame([(*k, w) for k, w in cases.items()], "a boolean, e boolean, d boolean, want boolean")
    assert all(r.got == r.want for r in df.select(recorded(F.col("a"), F.col("e"), F.col("d")).alias("got"), "want").collect())


def test_state_keeps_last_send_when_absent(spark):
    rows = [("a", 1, "x", T), ("a", 2, "y", None), ("b", 1, None, None), ("b", 2, "z", None)]
    df = spark.createDataFrame(rows, "region string, offset bigint, signature string, last_sent timestamp")
    got = {r.region: (r.signature, r.last_sent) for r in d.state_upsert(df).collect()}
    assert got == {"a": ("y", T), "b": ("z", None)}


def test_state_lookup_falls_back_by_row_presence(spark):
    regions = spark.createDataFrame([("a",), ("b",), ("c",)], "region string")
    state = spark.createDataFrame([("a", None, T)], "region string, signature string, last_sent timestamp")
    history = spark.createDataFrame(
        [("a", "2026-07-01", "old"), ("b", "2026-07-01", "older"), ("b", "2026-07-02", "newer")],
        "region string, timestamp string, grade_signature string",
    )
    got = {r.region: (r.signature, r.source) for r in d.state_lookup(regions, state, history).collect()}
    assert got == {"a": (None, "state"), "b": ("newer", "history"), "c": (None, "none")}


def test_outbox_and_delivered_channels(spark):
    sent = spark.createDataFrame([("e1", "r", 1, True), ("e2", "r", 2, False)], "event_id string, region string, offset bigint, send boolean")
    assert {(r.event_id, r.channel) for r in d.channel_outbox(sent).collect()} == {("e1", c) for c in ("slack", "email", "kakao")}
    results = spark.createDataFrame([("e1", "kakao", True), ("e1", "slack", True), ("e1", "slack", False), ("e1", "email", False)], "event_id string, channel string, ok boolean")
    got = {r.event_id: r.delivered_channels for r in d.delivered_channels(sent, results).collect()}
    assert got == {"e1": ["slack", "kakao"], "e2": []}


def test_last_write_wins_per_month(spark):
    rows = [("2026.07", "e1", 1, "a"), ("2026.07", "e1", 3, "c"), ("2026.07", "e1", 2, "b"), ("2026.08", "e1", 1, "d")]
    df = spark.createDataFrame(rows, "month string, event_id string, offset bigint, v string")
    assert {(r.month, r.v) for r in d.upsert_history(df).collect()} == {("2026.07", "c"), ("2026.08", "d")}
    assert d.duplicate_events(df).head().copies == 4


def test_failed_is_not_suppressed(spark):
    rows = [("e1", True, ["slack"]), ("e2", True, []), ("e3", False, [])]
    df = spark.createDataFrame(rows, "event_id string, send boolean, delivered_channels array<string>").selectExpr(
        "*", "'r' as region", "'2026-07-30T12:00:00+00:00' as timestamp", "array('pm10') as missing", "'LOW' as severity",
        "100.25D as duration_ms", "true as indexed",
    )
    out = d.message_metrics(df, F.lit(dt.datetime(2026, 7, 30, 12, 0, 12, 500000)).cast("timestamp"))
    got = {r.event_id: (r.external_attempted, r.delivery_failed, r.suppressed, r.e2e_latency_seconds, r.missing_count) for r in out.collect()}
    assert got == {"e1": (True, False, False, 12.5, 1), "e2": (True, True, False, 12.5, 1), "e3": (False, False, True, 12.5, 1)}
