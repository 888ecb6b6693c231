"""The chain from portal replies to messages: outcomes of each source, and the day of a slot."""

import json
from datetime import datetime

import pytest

from skygauge import fixed
from skygauge.operators import collect, merge

SCHEMA = "source string, region string, slot timestamp, status_code int, payload string"
NOON, SIX, MIDNIGHT = (datetime(2024, 3, 5, h) for h in (12, 6, 0))


def ok(*items):
    return 200, json.dumps({"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": list(items)}}}})


def at(category, value, time="1200", day="20240305"):
    return {"category": category, "fcstDate": day, "fcstTime": time, "fcstValue": value}


FULL = {
    "air": ok({"pm10Value": "30", "pm25Value": "-"}, {"pm10Value": "33", "pm25Value": "8"}),
    "dust": ok({"tmArea": "North", "dataTime": "2024030509"}, {"tmArea": "Seoul, Busan", "dataTime": "2024030508"}),
    "oak_pollen": ok({"today": "", "tomorrow": "2"}),
    "pine_pollen": ok({"today": "1"}),
    "living": ok({"h1": "21", "h2": "25"}),
    "uv": ok({"date": "2024030500", "h9": "4", "h12": "7", "h15": "9"}),
    "village": ok(at("POP", "10", "0900"), at("POP", "60", "1500"), at("TMP", "3", "0300"), at("TMP", "14"), at("WSD", "9.5")),
    "observed": ok({"category": "T1H", "obsrValue": "12.5"}),
    "short": ok(at("LGT", "0"), at("WSD", "3"), at("PTY", "1"), at("WSD", "20")),
}


def run(spark, *cases):
    rows = [(s, region, slot, *reply) for region, slot, replies in cases for s, reply in replies.items()]
    return {(r["region"], r["slot"]): r for r in collect.collect(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_full_slot_at_noon_six_and_midnight(spark):
    found = run(spark, ("Seoul", NOON, FULL), ("Seoul", SIX, FULL), ("Seoul", MIDNIGHT, FULL))
    noon, six, midnight = (found["Seoul", t] for t in (NOON, SIX, MIDNIGHT))
    for r in (noon, six, midnight):
        assert (r["pm10"], r["pm25"], r["oak_pollen"], r["pine_pollen"]) == (31.5, 8.0, 2.0, 1.0)
        assert (r["yellow_dust"], r["yellow_dust_advisory"]) == (500.0, fixed.ADVISORY_ISSUED)
        assert r["data_warnings"] == {} and r["data_type"] == "current_weather"
    assert [r["uv_index"] for r in (noon, six, midnight)] == [7.0, 4.0, 4.0]
    assert [r["feels_like_temp"] for r in (noon, six, midnight)] == [12.5, 12.5, 25.0]
    assert [r["precipitation_probability"] for r in (noon, six, midnight)] == [60.0, 60.0, 60.0]
    assert six["precipitation_probability_source"] == "today_max_forecast_probability"
    assert (midnight["min_temperature"], midnight["max_temperature"], noon["min_temperature"]) == (3.0, 14.0, None)
    assert noon["other_special_notice"] == fixed.SIGNAL_RAIN
    assert midnight["other_special_notice"] == fixed.TODAY_PREFIX + fixed.SIGNAL_WIND
    assert noon["timestamp"] == "2024-03-05T12:00:00+09:00"


def test_failures_are_named_and_masked_and_absence_is_no_failure(spark):
    failed = {s: (503, f"down serviceKey=s3cret {s}") for s in FULL}
    found = run(spark, ("Seoul", NOON, failed), ("Busan", MIDNIGHT, failed), ("Jeju", NOON, {"oak_pollen": FULL["oak_pollen"]}))
    seoul, busan, jeju = found["Seoul", NOON], found["Busan", MIDNIGHT], found["Jeju", NOON]
    assert set(seoul["data_warnings"]) == {"air_quality", "yellow_dust", "living_index", "uv_index"}
    assert set(busan["data_warnings"]) == {"air_quality", "yellow_dust", "living_index", "uv_index", "today_forecast"}
    for r in (seoul, busan):
        assert all("http 503" in t and "s3cret" not in t for t in r["data_warnings"].values())
        assert r["yellow_dust"] is None and r["yellow_dust_source"] == "ylwsnd_advisory_unavailable"
        assert all(r[i] is None for i in ("pm10", "uv_index", "feels_like_temp", "precipitation_probability"))
        assert r["other_special_notice"] == fixed.NOTICE_UNKNOWN
    assert jeju["data_warnings"]["air_quality"] == fixed.WARN_AIR and jeju["oak_pollen"] == 2.0
    assert jeju["yellow_dust"] is None and jeju["other_special_notice"] is None


def test_empty_replies_and_unreadable_values(spark):
    empty = {s: ok() for s in FULL}
    odd = {
        "air": ok({"pm10Value": "x"}),
        "dust": ok({"tmArea": None, "issueArea": "Busan", "dataTime": None}),
        "uv": ok({"date": "soon", "h3": "-"}),
        "observed": ok({"category": "T1H", "obsrValue": "-"}),
        "short": ok(at("T1H", "8")),
        "village": ok(at("POP", "5", day="20240306")),
    }
    found = run(spark, ("Seoul", NOON, empty), ("Busan", NOON, odd), ("Busan", MIDNIGHT, odd))
    seoul, busan = found["Seoul", NOON], found["Busan", NOON]
    # the advisory source answered: nothing is issued; all others brought nothing
    assert (seoul["yellow_dust"], seoul["yellow_dust_advisory"]) == (0.0, fixed.ADVISORY_NONE)
    assert seoul["pm10"] is None and seoul["other_special_notice"] == fixed.NOTICE_UNKNOWN
    # an unreadable observation does not fall through to the forecast
    assert busan["feels_like_temp"] is None and busan["uv_index"] is None and busan["pm10"] is None
    assert "air_quality" not in busan["data_warnings"] and busan["yellow_dust"] == 0.0
    assert busan["precipitation_probability"] == 5.0
    assert found["Busan", MIDNIGHT]["precipitation_probability"] is None  # no item of that day


def test_places_gate_and_empty_table(spark):
    rows = [(s, "Seoul", NOON, *reply) for s, reply in FULL.items()] + [("uv", "Jeju", NOON, *ok({"today": "3"}))]
    replies = spark.createDataFrame(rows, SCHEMA)
    places = spark.createDataFrame([("Seoul", "11", 60, 127, 37.5, 126.9)], "region string, area_no string, nx int, ny int, latitude double, longitude double")
    out, rejected = merge.publish_gate(collect.collect(replies, places), minimum=4)
    sent = out.collect()
    assert [(r["event_id"], r["area_no"], r["ny"]) for r in sent] == [("Seoul:2024030512", "11", 127)]
    assert [(r["region"], r["collected"]) for r in rejected.collect()] == [("Jeju", 1)]
    none = collect.collect(replies.limit(0), places)
    assert none.count() == 0
    with pytest.raises(Exception, match="no message was published"):
        merge.require_published(merge.publish_gate(none)[0]).collect()
