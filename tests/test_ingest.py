import json

import pytest
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.operators import ingest, merge

HEADER = {"resultCode": "00", "resultMsg": "NORMAL_SERVICE"}


def reply(items, **response):
    return json.dumps({"response": {"header": HEADER, "body": {"items": items}, **response}}, ensure_ascii=False)


STATIONS = [
    {"stationName": "north pier", "pm10Value": "57", "pm25Value": "-", "no2Value": "0.031", "so2Value": ""},
    {"stationName": "old mill", "pm10Value": "48", "pm25Value": "9", "no2Value": "-", "so2Value": "0.011"},
    {"stationName": "east gate", "pm10Value": "", "pm25Value": "16", "no2Value": "0.007", "so2Value": "-"},
]
XML = """<?xml version="1.0" encoding="UTF-8"?>
<response><header><resultCode>00</resultCode><resultMsg>NORMAL_SERVICE</resultMsg></header><body><items>
<item><code>Q1</code><areaNo>4200000000</areaNo><date>2031021518</date><today>1</today><tomorrow>4</tomorrow></item>
</items></body></response>"""
HEALTH = {"code": "Q1", "areaNo": "4200000000", "date": "2031021518", "today": "1", "tomorrow": "4"}


def parse(spark, *payloads, status=200):
    df = spark.createDataFrame([(i, status, p) for i, p in enumerate(payloads)], "id int, status_code int, payload string")
    return ingest.parse_payloads(df)


def items_of(spark, payload, **options):
    return ingest.explode_items(parse(spark, payload, **options), ["id"]).orderBy("ord").collect()


def test_three_layouts_and_none(spark):
    assert [r.item for r in items_of(spark, reply(STATIONS))] == STATIONS
    assert [r.item for r in items_of(spark, reply({"item": [HEALTH]}))] == [HEALTH]
    assert [r.item for r in items_of(spark, reply({"item": HEALTH}))] == [HEALTH]
    assert items_of(spark, reply("")) == []
    assert items_of(spark, json.dumps({"response": {"header": HEADER}})) == []


def test_xml_equals_json(spark):
    assert [r.item for r in items_of(spark, XML)] == [r.item for r in items_of(spark, reply({"item": [HEALTH]}))]


@pytest.mark.parametrize(
    "response,ok",
    [({"status": "00"}, True), ({"header": {"resultCode": "0"}}, True), ({"header": {"resultCode": "00"}}, True), ({"header": {"resultCode": "03"}}, False), ({}, False)],
)
def test_success_marks(spark, response, ok):
    payload = json.dumps({"response": {**response, "body": {"items": [HEALTH]}}})
    row = parse(spark, payload).head()
    assert (row.error is None) == ok and len(row["items"]) == int(ok)


def test_error_rows(spark):
    rows = parse(spark, "<html>", "nothing", None).collect()
    assert [r.error for r in rows][1:] == ["unreadable", "unreadable"] and rows[0].error is not None
    assert parse(spark, reply([HEALTH]), status=503).head().error == "http 503"


def test_forecast_value_order(spark):
    cases = [
        ({"today": "", "tomorrow": "3"}, 3.0),
        ({"today": "2", "tomorrow": "3"}, 2.0),
        ({"h12": "9", "h3": "-", "h6": "4", "high": "1"}, 4.0),
        ({"today": "-", "h0": "x"}, None),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, item map<string,string>")
    got = {r.i: r.x for r in df.selectExpr("i", f"{ingest.forecast_value('item')} as x").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    zero = df.where("i = 3").selectExpr(f"{ingest.forecast_value('item', missing_as_zero=True)} as x").head().x
    assert zero == 0.0


UV = {"date": "2031021518", "h0": "2", "h3": "6", "h6": "", "h9": "7", "h12": "4", "h15": "-"}


@pytest.mark.parametrize(
    "base,now,want",
    [
        ("2031021518", "2031-02-16 03:10:00", 7.0),
        ("2031021518", "2031-02-16 02:00:00", 6.0),
        ("2031021518", "2031-02-15 17:00:00", 2.0),
        ("2031021518", "2031-02-20 00:00:00", 4.0),
        ("bad", "2031-02-16 03:10:00", None),
        (None, "2031-02-16 03:10:00", None),
    ],
)
def test_latest_hourly_value(spark, base, now, want):
    df = spark.createDataFrame([("r", base, UV)], "region string, base string, item map<string,string>")
    rows = ingest.hourly_rows(df, ["region"], "base")
    got = ingest.asof_backward(rows, ["region"], "at", "value", F.lit(now).cast("timestamp_ntz")).collect()
    assert [r.value for r in got] == ([want] if want is not None else [])


def test_forward_pick_follows_input_order(spark):
    rows = [("r", 0, "202607301200", "10"), ("r", 1, "202607301600", "40"), ("r", 2, "202607301500", "30")]
    df = spark.createDataFrame(rows, "region string, ord int, k string, v string")
    pick = lambda now: ingest.asof_forward(df, ["region"], "k", "v", "ord", F.lit(now)).head().v
    assert pick("202607301400") == "40" and pick("202607302300") == "10"


def test_observed_else_forecast(spark):
    schema = "region string, ord int, kind string, category string, obsr_value string, fcst_value string"
    rows = [
        ("a", 0, "observed", "REH", "60", None), ("a", 1, "observed", "T1H", "21.5", None), ("a", 2, "forecast", "T1H", None, "30"),
        ("b", 0, "observed", "REH", "60", None), ("b", 1, "forecast", "T1H", None, "30"), ("b", 2, "forecast", "T1H", None, "31"),
        ("c", 0, "observed", "T1H", "-", None), ("c", 1, "forecast", "T1H", None, "9"),
        ("d", 0, "observed", "REH", "1", None),
    ]
    got = ingest.observed_else_forecast(spark.createDataFrame(rows, schema), ["region"], "ord").collect()
    assert {r.region: r.current_temperature for r in got} == {"a": 21.5, "b": 30.0, "c": None, "d": None}


def test_notice_signals(spark):
    rows = [
        ("a", 0, "LGT", "1"), ("a", 1, "WSD", "9"), ("a", 2, "PTY", "1"), ("a", 3, "LGT", "0"),
        ("b", 0, "LGT", "0"), ("b", 1, "WSD", "8.9"), ("b", 2, "PTY", "0"),
        ("c", None, None, None),
        ("d", 0, "WSD", None), ("d", 1, "WSD", "20"),
    ]
    df = spark.createDataFrame(rows, "region string, ord int, category string, fcst_value string")
    got = {r.region: r.notice for r in ingest.notice_signals(df, ["region"], "ord").collect()}
    assert got == {"a": "낙뢰 가능, 강풍 가능, 강수 가능", "b": "없음", "c": "정보없음", "d": "없음"}


def test_daily_summary_remaining_or_all(spark):
    def f(region, hour, category, value, now="202607301200"):
        return (region, now, "20260730", f"20260730{hour:02d}00", category, value)

    rows = [
        f("a", 6, "POP", "90"), f("a", 15, "POP", "30"), f("a", 18, "POP", "60"), f("a", 15, "TMP", "25"), f("a", 18, "TMP", "-"),
        f("a", 15, "PTY", "0"), f("a", 18, "PTY", "1"), f("a", 18, "WSD", "9"),
        f("b", 3, "POP", "20"), f("b", 6, "TMP", "11"),
        ("b", "202607301200", "20260731", "202607310300", "POP", "99"),
    ]
    df = spark.createDataFrame(rows, "region string, now_key string, fcst_date string, fcst_key string, category string, fcst_value string")
    got = {r.region: r for r in ingest.daily_summary(df, ["region"], "now_key").collect()}
    a, b = got["a"], got["b"]
    assert (a.pop_max, a.pop_min, a.tmp_max, a.tmp_min, a.wsd_max, a.pty) == (60.0, 30.0, 25.0, 25.0, 9.0, ["0", "1"])
    assert (a.start, a.end, a.notice) == ("202607301500", "202607301800", "오늘 강풍 가능, 오늘 강수 가능")
    assert (b.pop_max, b.tmp_max, b.notice, b.lgt_max) == (20.0, 11.0, "없음", 0.0)
    whole = {r.region: r for r in ingest.daily_summary(df, ["region"], "now_key", include_elapsed=True).collect()}
    assert whole["a"].pop_max == 90.0 and whole["a"].period == "today_full"


def test_station_mean(spark):
    items = spark.createDataFrame([("서울", s.get("pm10Value"), s.get("pm25Value"), s.get("no2Value")) for s in STATIONS] + [("부산", "-", None, "")], "region string, pm10 string, pm25 string, no2 string")
    got = {r.region: r for r in ingest.station_mean(items, ["region"], ("pm10", "pm25", "no2")).collect()}
    assert (got["서울"].pm10, got["서울"].pm25, got["서울"].station_count) == (52.5, 12.5, 3)
    assert (got["부산"].pm10, got["부산"].pm25, got["부산"].no2, got["부산"].station_count) == (None, None, None, 1)


def test_advisory_match(spark):
    regions = spark.createDataFrame([("서울",), ("부산",), ("제주",)], "region string")
    rows = [(0, "서울특별시 인천광역시", "2026073009", "1"), (1, "서울", "2026010109", "1"), (2, "부산광역시", "2026010109", "2")]
    df = spark.createDataFrame(rows, "ord int, area string, data_time string, count string")
    got = {r.region: (r.yellow_dust_advisory, r.yellow_dust, r.matched_time) for r in ingest.advisory_match(regions, df, "20260730").collect()}
    assert got == {"서울": ("발생", 500.0, "2026073009"), "부산": ("없음", 0.0, "2026010109"), "제주": ("없음", 0.0, None)}


# -- merging --------------------------------------------------------------------------------------

KEY = "region string, slot timestamp_ntz"


def feed(spark, slot, columns, *values):
    import datetime as dt

    return spark.createDataFrame([("서울", dt.datetime.fromisoformat(slot), *values)], f"{KEY}, {columns}")


def stacked(spark, slot="2026-07-30 12:00:00", **feeds):
    spine = feed(spark, slot, "x int", 1)
    made = {
        "air": lambda: feed(spark, slot, "pm10 double, pm25 double", 31.0, 12.0),
        "temp": lambda: feed(spark, slot, "current_temperature double, temperature_source string", 21.0, "T1H"),
        "living": lambda: feed(spark, slot, "living_temp double, living_max double", 25.0, 28.0),
        "today": lambda: feed(spark, slot, "today_pop double, today_min double, today_max double, today_notice string", 70.0, 19.0, 30.0, "없음"),
        "denied": lambda: feed(spark, slot, "yellow_dust double, dust_status string, dust_message string", None, "unavailable", "no rights"),
        "uv": lambda: feed(spark, slot, "uv_index double", 6.0),
    }
    use = {("dust" if n == "denied" else n): made[n]() for n, wanted in feeds.items() if wanted}
    return merge.stack_feeds(spine, use)


def test_current_prefers_the_observation(spark):
    row = merge.merge_current(stacked(spark, air=True, temp=True, living=True, uv=True)).head()
    assert (row.feels_like_temp, row.feels_like_temp_source, row.pm10) == (21.0, "T1H", 31.0)
    assert row.data_warnings == {"yellow_dust": fixed.WARN_DUST}


def test_current_falls_back_and_says_so(spark):
    row = merge.merge_current(stacked(spark, living=True, denied=True)).head()
    assert (row.feels_like_temp, row.feels_like_temp_source, row.yellow_dust) == (25.0, "living_weather_index", None)
    assert row.data_warnings == {
        "air_quality": fixed.WARN_AIR, "yellow_dust": "no rights", "temperature": fixed.WARN_TEMPERATURE, "uv_index": fixed.WARN_UV,
    }
    empty = merge.merge_current(stacked(spark)).head()
    assert empty.feels_like_temp is None and empty.data_warnings["living_index"] == fixed.WARN_LIVING


def test_daily_and_morning(spark):
    base = stacked(spark, air=True, temp=True, living=True, today=True)
    daily = merge.merge_daily(base).head()
    assert (daily.feels_like_temp, daily.feels_like_temp_source, daily.precipitation_probability) == (28.0, "living_weather_index_today_max", 70.0)
    assert (daily.min_temperature, daily.max_temperature, daily.other_special_notice, daily.forecast_date) == (19.0, 30.0, "없음", "20260730")
    bare = merge.merge_daily(stacked(spark, temp=True)).head()
    assert (bare.feels_like_temp, bare.other_special_notice) == (None, "정보없음")
    morning = merge.merge_morning(stacked(spark, temp=True)).head()
    assert morning.precipitation_probability is None and morning.data_warnings["today_forecast"] == fixed.WARN_TODAY
    assert merge.merge_morning(base).head().precipitation_probability == 70.0


@pytest.mark.parametrize("hour,kind", [(0, "daily_full_forecast"), (6, "morning_mixed"), (12, "current_conditions"), (18, "current_conditions"), (3, "current_conditions")])
def test_slot_dispatch(spark, hour, kind):
    assert merge.slot_dispatch(stacked(spark, f"2026-07-30 {hour:02d}:00:00", air=True)).head().forecast_type == kind


def test_completeness_and_publish_gate(spark):
    full = merge.merge_current(stacked(spark, air=True, temp=True, uv=True))
    row = merge.completeness(full).head()
    assert row.collected == 4 and row.publishable
    assert row.missing == ["oak_pollen", "pine_pollen", "yellow_dust", "precipitation_probability", "other_special_notice"]
    out, rejected = merge.publish_gate(full)
    assert rejected.isEmpty()
    assert (out.head().event_id, out.head().schema_version) == ("서울:2026073012", 1)
    out, rejected = merge.publish_gate(merge.merge_current(stacked(spark)))
    assert out.isEmpty() and rejected.head().collected == 0


def test_empty_replies_hold_no_item(spark):
    replies = ['""', "null", "[]", '[{"a": 1}]', '{"a": 1}']
    rows = [(i, 200, f'{{"response": {{"header": {{"resultCode": "00"}}, "body": {{"items": {{"item": {r}}}}}}}}}') for i, r in enumerate(replies)]
    out = ingest.parse_payloads(spark.createDataFrame(rows, "id int, status_code int, payload string")).orderBy("id")
    assert [len(r["items"]) for r in out.collect()] == [0, 0, 0, 1, 1]


def test_station_mean_counts_only_what_it_sums(spark):
    rows = [("k", "10"), ("k", "inf"), ("k", "nan"), ("k", "1e300"), ("k", "-")]
    out = ingest.station_mean(spark.createDataFrame(rows, "k string, pm10 string"), ["k"], ["pm10"]).head()
    assert (out.pm10, out.station_count) == (10.0, 5)


def test_a_failed_feed_is_named_and_brings_nothing(spark):
    slot = "2026-07-30 12:00:00"
    failed = [("air", "EXC url?serviceKey=abc123&x=1"), ("uv", None), ("living", "500"), ("living", "403"), ("dust", "no reply"), ("other", "x")]
    failures = feed(spark, slot, "feed string, message string", *failed[0])
    for f in failed[1:]:
        failures = failures.unionAll(feed(spark, slot, "feed string, message string", *f))
    spine = feed(spark, slot, "x int", 1)
    for both in ({}, {"air": feed(spark, slot, "pm10 double", 31.0)}):  # a value beside a failure stays a value
        stacked_rows = merge.stack_feeds(spine, both, failures)
        row = stacked_rows.head()
        assert row.has_air is bool(both) and not row.has_uv and not row.has_dust and not row.has_temp
        current, morning = merge.merge_current(stacked_rows).head(), merge.merge_morning(stacked_rows).head()
        want = {"yellow_dust": "no reply", "living_index": "403", "uv_index": fixed.WARN_UV}
        want |= {} if both else {"air_quality": "EXC url?serviceKey=***&x=1"}
        assert current.data_warnings == want and current.yellow_dust is None
        assert morning.data_warnings == want | {"today_forecast": fixed.WARN_TODAY}


def test_an_outage_is_not_none(spark):
    regions = spark.createDataFrame([("서울",), ("부산",)], "region string")
    schema = "ord int, area string, data_time string, count int"
    nothing, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, "대구", "2024011509", 1)], schema)
    failed = spark.createDataFrame([("http 503 serviceKey=abc",), (None,), ("b",)], "message string")

    def states(*args):
        return {(r.yellow_dust, r.yellow_dust_advisory, r.dust_status, r.yellow_dust_source) for r in ingest.advisory_match(regions, *args).collect()}

    none, unknown = (0.0, "없음", None, "ylwsnd_advisory"), (None, None, "unavailable", "ylwsnd_advisory_unavailable")
    assert states(nothing, "20240115") == states(nothing, "20240115", failed.limit(0)) == {none}
    assert states(nothing, "20240115", failed) == {unknown}
    assert states(some, "20240115", failed) == {none}  # a later call brought items
    told = ingest.advisory_match(regions, nothing, "20240115", failed.where("message like 'http%'")).head()
    assert told.dust_message == "http 503 serviceKey=***"


def index_items(spark, *items):
    rows = [(i, item, base) for i, (base, item) in enumerate(items)]
    df = spark.createDataFrame(rows, "id int, item map<string,string>, base string")
    return df.withColumn("now", F.expr("timestamp_ntz'2031-02-15 09:30:00'"))


def test_uv_feed_takes_the_hour_in_force(spark):
    hours = {"h9": "7", "h0": "1", "h3": "4", "h12": "-", "h100000000": "9", "today": "-", "tomorrow": "8", "high": "2"}
    given = [
        ("2031021506", hours),  # 06 + 3 hours is the latest at or before half past nine
        ("2031021520", hours),  # all ahead: the earliest
        ("2031029906", hours),  # no such time
        ("soon", {"h3": "4"}),
        (None, {"today": "", "h3": "-"}),
        ("2031021506", {}),
    ]
    rows = ingest.uv_feed(index_items(spark, *given), ["id"], "base", "now").orderBy("id").collect()
    assert [r["uv_index"] for r in rows] == [4, 1, 8, 4, None, None]
    assert [r["uv_selected_hour"] for r in rows] == ["h3", "h0", None, None, None, None]
    assert [r["uv_selected_time"] for r in rows[:3]] == ["2031021509", "2031021520", None]
    assert rows[0]["uv_forecast"] == {"today": None, "tomorrow": 8}
    assert rows[0]["uv_hourly_forecast"] == {"h0": 1, "h3": 4, "h9": 7, "h12": None, "h100000000": 9}
    assert rows[4]["uv_forecast"] == {} and rows[4]["uv_hourly_forecast"] == {"h3": None}


def test_living_feed_gives_first_and_largest(spark):
    given = [(None, {"h9": "7", "h3": "-4", "h1": "-"}), (None, {"today": "3"}), (None, {"today": "3", "h5": "2"}), (None, {})]
    rows = ingest.living_feed(index_items(spark, *given), ["id"]).orderBy("id").collect()
    assert [(r["living_temp"], r["living_max"]) for r in rows] == [(-4, 7), (3, 3), (3, 2), (None, None)]


def test_a_run_that_publishes_nothing_fails(spark):
    rows = spark.range(3).selectExpr("id", "cast(id as string) as name")
    assert merge.require_published(rows).count() == 3
    with pytest.raises(Exception, match="no message was published"):
        merge.require_published(rows.where("id > 5")).collect()
