import datetime as dt
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.operators import monitor as m
from skygauge.sources import tables

NOW = dt.datetime(2026, 7, 30, 12)
METRIC = (
    "event_id string, region string, processed_at timestamp, process_duration_ms double, e2e_latency_seconds double, "
    "delivery_failed boolean, suppressed boolean, missing_indices array<string>, missing_count int, indexed boolean"
)


def metric(i, minutes=0, proc=100.0, e2e=5.0, failed=False, missing=(), indexed=True):
    return (f"e{i:03d}", "r", NOW - dt.timedelta(minutes=minutes), proc, e2e, failed, False, list(missing), len(missing), indexed)


def now():
    return F.lit(NOW).cast("timestamp")


def test_summary_of_a_window(spark):
    rng = random.Random(1)
    proc = [round(rng.uniform(50, 500), 1) for _ in range(100)]
    rows = [metric(i, i, proc[i], proc[i] / 10, missing=["pm10"] * (i < 7), indexed=i >= 2) for i in range(100)]
    rows.append(metric(999, 8 * 24 * 60, 1e6, 1e6))
    r = m.perf_summary(spark.createDataFrame(rows, METRIC), now(), "7d").head()
    assert (r.n, r.throughput_per_day, r.index_success_rate, r.missing_rate) == (100, 14.3, 0.98, 0.07)
    for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert r[f"proc_{p}"] == pytest.approx(np.quantile(proc, q), abs=0.051)
        assert r[f"e2e_{p}"] == pytest.approx(np.quantile(proc, q) / 10, abs=0.051)


def test_summary_of_nothing(spark):
    r = m.perf_summary(spark.createDataFrame([], METRIC), now(), "7d").head()
    assert (r.n, r.throughput_per_day, r.index_success_rate, r.missing_rate, r.proc_p95) == (0, 0.0, None, None, None)


def test_lag(spark):
    committed = spark.createDataFrame([(0, 10), (1, 20), (2, 5), (3, 9)], "partition int, committed bigint")
    ends = spark.createDataFrame([(0, 13), (1, 20), (3, 4)], "partition int, end bigint")
    assert {r.partition: r.lag for r in m.partition_lag(committed, ends).collect()} == {0: 3, 1: 0, 3: 0}


REPORT = "e2e_p95 double, proc_p95 double, index_success_rate double, max_lag bigint"


@pytest.mark.parametrize(
    "prev,curr,want",
    [
        (None, (10.0, 100.0, 1.0, 0), ["첫 회차"]),
        ((10.0, 100.0, 1.0, 0), (16.0, 100.0, 1.0, 0), ["⚠️ e2e_latency_seconds p95 10.0 → 16.0 (+60%)"]),
        ((15.0, 300.0, 1.0, 0), (16.0, 320.0, 1.0, 0), ["회귀 없음"]),
        ((15.0, 300.0, 1.0, 0), (16.0, 300.0, 0.9, 15), ["⚠️ 색인 성공률 0.9 < 0.98", "⚠️ Kafka max lag 15 > 10"]),
        ((0.0, None, None, None), (16.0, None, None, None), ["회귀 없음"]),
    ],
)
def test_compare(spark, prev, curr, want):
    previous = spark.createDataFrame([prev] if prev else [], REPORT)
    got = m.perf_compare(previous, spark.createDataFrame([curr], REPORT)).orderBy("position").collect()
    assert len(got) == len(want)
    assert all(r.finding.startswith(w) for r, w in zip(got, want))


def test_reports_round_trip(spark, tmp_path):
    path = str(tmp_path / "reports")
    for stamp, p95 in (("20260701-000000", 1.0), ("20260702-000000", 2.0)):
        tables.write_report(spark.createDataFrame([(p95, 1.0, 1.0, 0)], REPORT), path, stamp)
    latest = m.latest_report(tables.read_reports(spark, path, REPORT), "stamp").head()
    assert (latest.stamp, latest.e2e_p95) == ("20260702-000000", 2.0)
    assert m.latest_report(spark.createDataFrame([], f"{REPORT}, stamp string"), "stamp").isEmpty()


def test_api_stats(spark):
    lines = [
        "INFO api_call api=kma_index status=200 duration_ms=200",
        "INFO api_call api=kma_index status=500 duration_ms=500",
        "WARN api_call api=airkorea status=EXC duration_ms=1200",
        "something else",
    ]
    calls = m.api_calls(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.api: (r.n, r.p50, r.p95) for r in m.api_call_stats(calls).collect()}
    assert got == {"kma_index": (2, 350.0, 500.0), "airkorea": (1, 1200.0, 1200.0)}
    fails = {r.api: (r.calls, r.exceptions, r.failures, r.failure_rate) for r in m.api_failure_rate(calls).collect()}
    assert fails == {"kma_index": (2, 0, 1, 0.5), "airkorea": (1, 1, 1, 1.0)}


def test_nearest_rank_for_many_sizes(spark):
    rng = random.Random(6)
    data = {f"n{n}": [float(rng.randint(1, 900)) for _ in range(n)] for n in (1, 2, 11, 21, 31, 101)}
    df = spark.createDataFrame([(a, "200", v) for a, vs in data.items() for v in vs], "api string, status string, duration_ms double")
    for r in m.api_call_stats(df).collect():
        s = sorted(data[r.api])
        assert r.p50 == round(median(s), 1)
        assert r.p95 == s[min(len(s) - 1, int(round(0.95 * (len(s) - 1))))]


def alarms(spark, rows=(), history=(NOW,), lag=((0, 0),), status="green"):
    metrics = spark.createDataFrame(list(rows), METRIC)
    past = spark.createDataFrame([(t,) for t in history], "at timestamp")
    lags = spark.createDataFrame(list(lag), "partition int, lag bigint")
    return {r.code: r for r in m.alarm_conditions(m.alarm_snapshot(metrics, past, lags, status, now())).collect()}


def test_alarm_conditions_one_by_one(spark):
    assert alarms(spark) == {}
    assert set(alarms(spark, history=[NOW - dt.timedelta(hours=8)])) == {"a"}
    assert alarms(spark, [metric(1, failed=True), metric(2, 71, failed=True)])["b"].title == "전달 실패 1건"
    assert set(alarms(spark, lag=[(0, 4)])) == set() and set(alarms(spark, lag=[(0, 5)])) == {"d"}
    assert set(alarms(spark, lag=[])) == set()
    assert set(alarms(spark, status="red")) == {"g"} and alarms(spark, status=None) == {}


def test_missing_data_alarm_lists_names_and_newest_events(spark):
    rows = [metric(i, i, missing=["uv_index", "pm10"] if i % 2 else ["pm25"]) for i in range(25)]
    got = alarms(spark, rows, history=[], lag=[(0, 9)], status="red")
    assert set(got) == {"a", "c", "d", "g"}
    assert got["c"].title == "결측 발생 20건"
    assert got["c"].missing == "pm10|pm25|uv_index"
    assert got["c"].event_ids == "e000|e001|e002|e003|e004"


def test_cooldown(spark):
    fired = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("g",)], "code string")
    zone = "+00:00"
    state = spark.createDataFrame(
        [("a", f"2026-07-30T11:50:00{zone}"), ("b", f"2026-07-30T10:30:00{zone}"), ("c", "garbage"), ("d", f"2026-07-30T11:00:00{zone}")],
        "code string, last_notified string",
    )
    assert {r.code for r in m.cooldown_filter(fired, state, now()).collect()} == {"b", "c", "d", "g"}


def test_cooldown_series(spark):
    ticks = [("a", i, NOW + dt.timedelta(minutes=20 * i)) for i in range(8)]
    got = m.cooldown_series(spark.createDataFrame(ticks, "code string, tick bigint, at timestamp")).collect()
    assert {r.tick for r in got if r.notify} == {0, 3, 6}


def test_silent_regions(spark):
    expected = spark.createDataFrame([("x",), ("y",), ("z",)], "region string")
    history = spark.createDataFrame([("x", NOW), ("y", NOW - dt.timedelta(hours=9))], "region string, at timestamp")
    assert {r.region for r in m.silent_regions(expected, history, now()).collect()} == {"y", "z"}


def test_allowlist(spark):
    df = spark.createDataFrame([("e", "r", "secret")], "event_id string, region string, raw string")
    assert tables.allowlisted(df).columns == ["event_id", "region"]
