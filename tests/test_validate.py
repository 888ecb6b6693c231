import random
import json

import pytest
from pyspark.sql import functions as F

from skygauge.operators import validate as v
from skygauge.sources.topic import RECORD_SCHEMA

OK = {"schema_version": 1, "event_id": "서울:2026073012", "timestamp": "2026-07-30T12:00:00+09:00", "region": "서울", "pm10": 31.5}


def message(**changes):
    m = {**OK, **changes}
    return json.dumps({k: x for k, x in m.items() if x is not ...}, ensure_ascii=False).encode()


GOOD = "valid"
CASES = [
    (message(), GOOD),
    (message(schema_version=...), GOOD),
    (message(schema_version=None), GOOD),
    (message(schema_version=1.0), GOOD),
    (message(schema_version=True), GOOD),
    (message(schema_version="1"), v.BAD_VERSION),
    (message(schema_version=99), v.BAD_VERSION),
    (message(schema_version=False), v.BAD_VERSION),
    (message(schema_version=[1]), v.BAD_VERSION),
    (b"{broken json", v.NOT_JSON),
    (b"", v.NOT_JSON),
    (b"\xff\xfe{}", v.NOT_JSON),
    (b"{'event_id': 'x'}", v.NOT_JSON),
    (message() + b" xyz", v.NOT_JSON),
    (message() + b"}", v.NOT_JSON),
    (message() + b"]", v.NOT_JSON),
    (message() + b"," + message(), v.NOT_JSON),
    (message() + message(), v.NOT_JSON),
    (message() + b"  \n", GOOD),
    (b"\n " + message(), GOOD),
    (b"[1, 2, 3]", v.NOT_OBJECT),
    (b"[1, 2", v.NOT_JSON),
    (b"null", v.NOT_OBJECT),
    (b"5", v.NOT_OBJECT),
    (b'"text"', v.NOT_OBJECT),
    (b"nonsense", v.NOT_JSON),
    (b"{}", v.MISSING_KEYS + "event_id, timestamp, region"),
    (message(event_id=None, region=""), v.MISSING_KEYS + "event_id, region"),
    (message(region=...), v.MISSING_KEYS + "region"),
    (message(event_id=0), v.MISSING_KEYS + "event_id"),
    (message(event_id=0.0), v.MISSING_KEYS + "event_id"),
    (message(event_id=False), v.MISSING_KEYS + "event_id"),
    (message(event_id=[]), v.MISSING_KEYS + "event_id"),
    (message(event_id={}), v.MISSING_KEYS + "event_id"),
    (message(event_id="0"), GOOD),
    (message(event_id="false"), GOOD),
    (message(event_id=" "), GOOD),
    (message(event_id=7), GOOD),
    (message(event_id=[None]), GOOD),
    (message(timestamp=20260730), v.BAD_TIME),
    (message(timestamp=["x"]), v.BAD_TIME),
    (message(pm10="-", pm25="12.5", uv_index=[1], data_warnings=None, other_special_notice={"a": 1}), GOOD),
    (None, v.EMPTY),
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [("t", 0, i, b"k", None if raw is None else bytearray(raw)) for i, (raw, _) in enumerate(CASES)]
    out = v.validate(spark.createDataFrame(rows, RECORD_SCHEMA)).drop("key")
    return {r.offset: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_first_failure_wins(checked, i):
    raw, want = CASES[i]
    got = checked[i].reason or GOOD
    assert got.startswith(want) if want == v.BAD_VERSION else got == want, raw


def test_fields_keep_missing_missing(checked):
    row = next(checked[i] for i, (raw, _) in enumerate(CASES) if raw and b'"12.5"' in raw)
    assert (row.pm10, row.pm25, row.uv_index, row.yellow_dust, row.data_warnings) == (None, 12.5, None, None, None)


def test_utc_suffix_is_normalised(spark):
    raw = message(timestamp="2026-07-30T03:00:00Z", data_warnings={"air_quality": "none"})
    df = spark.createDataFrame([("t", 0, 1, b"k", bytearray(raw))], RECORD_SCHEMA)
    row = v.valid_messages(v.validate(df)).head()
    assert row.timestamp == "2026-07-30T03:00:00+00:00"
    assert row.data_warnings == {"air_quality": "none"}
    assert row.pm10 == 31.5


def test_dead_letter_keeps_position_and_text(spark):
    df = spark.createDataFrame([("t", 3, 9, b"k", bytearray(b"\xffbad"))], RECORD_SCHEMA)
    row = v.dead_letters(v.validate(df), F.lit("now")).head()
    assert (row.source_topic, row.source_partition, row.source_offset, row.failed_at) == ("t", 3, 9, "now")
    assert row.raw == "�bad"


def test_commit_stops_at_the_first_failure(spark):
    rows = [("t", 0, 10, False), ("t", 0, 11, True), ("t", 0, 12, False), ("t", 1, 20, False), ("t", 2, 5, True), ("t", 3, 7, False), ("t", 3, 9, True)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, failed boolean")
    got = {r.partition: (r["commit"], r.retry_from, r.processed, r.waiting) for r in v.commit_positions(df).collect()}
    assert got == {0: (11, 11, 1, 2), 1: (21, None, 1, 0), 2: (None, 5, 0, 1), 3: (8, 9, 1, 1)}


def test_commit_positions_by_chunks(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for p in range(12):
        offsets = sorted(rng.sample(range(400), 120))
        failed = {o for o in offsets if rng.random() < (0, 0.01, 0.1)[p % 3]}
        rows += [("t", p, o, o in failed) for o in offsets]
        first = min(failed, default=None)
        ready = [o for o in offsets if first is None or o < first]
        want[p] = (ready[-1] + 1 if ready else None, first, len(ready), len(offsets) - len(ready))
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, failed boolean").repartition(4)
    for chunk in (1, 16, 1 << 18):
        out = v.commit_positions(df, chunk)
        assert {r.partition: (r["commit"], r.retry_from, r.processed, r.waiting) for r in out.collect()} == want
    plan = v.commit_positions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1
