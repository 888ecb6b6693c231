import pytest
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions import grading as g
from skygauge.plans import catalog
from tests.conftest import SF_SMALL

MESSAGE = (
    "oak_pollen double, pine_pollen double, pm10 double, pm25 double, yellow_dust double, feels_like_temp double, "
    "other_special_notice string, precipitation_probability double, uv_index double"
)
GOOD = dict(
    oak_pollen=1.0, pine_pollen=1.0, pm10=10.0, pm25=5.0, yellow_dust=0.0, feels_like_temp=15.0,
    other_special_notice="없음", precipitation_probability=0.0, uv_index=1.0,
)
EMPTY = dict.fromkeys(GOOD)


def graded(spark, *messages):
    rows = [tuple({**GOOD, **m}[c] for c in GOOD) for m in messages]
    return g.with_grades(spark.createDataFrame(rows, MESSAGE), advice=True, icon=True)


BOUNDS = {
    "pm10": [(30, "GOOD"), (31, "NORMAL"), (80, "NORMAL"), (81, "BAD"), (150, "BAD"), (151, "VERY_BAD"), (9999, "VERY_BAD"), (0, "GOOD")],
    "pm25": [(15, "GOOD"), (35, "NORMAL"), (75, "BAD"), (76, "VERY_BAD")],
    "uv_index": [(2, "GOOD"), (3, "NORMAL"), (6, "BAD"), (8, "VERY_BAD")],
    "yellow_dust": [(0, "GOOD"), (150, "GOOD"), (300, "NORMAL"), (500, "BAD"), (501, "VERY_BAD")],
    "oak_pollen": [(1, "GOOD"), (2, "NORMAL"), (3, "BAD"), (4, "VERY_BAD"), (9, "VERY_BAD")],
    "precipitation_probability": [(30, "GOOD"), (60, "NORMAL"), (80, "BAD"), (100, "VERY_BAD")],
    "feels_like_temp": [(-3, "VERY_BAD"), (0, "VERY_BAD"), (5, "BAD"), (10, "NORMAL"), (20, "GOOD"), (21, "BAD"), (300, "BAD")],
}


def test_band_bounds(spark):
    cases = [(i, v, w) for i, vs in BOUNDS.items() for v, w in vs] + [(i, None, "UNKNOWN") for i in BOUNDS]
    cases.append(("pm10", float("nan"), "VERY_BAD"))
    got = graded(spark, *[{i: None if v is None else float(v)} for i, v, _ in cases]).collect()
    for (index, value, want), row in zip(cases, got):
        name = "dust" if index == "yellow_dust" else index
        assert row[f"{name}_grade"] == want, (index, value)


@pytest.mark.parametrize("text,want", [("없음", "GOOD"), ("정보없음", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("강풍 가능", "BAD")])
def test_notice(spark, text, want):
    assert graded(spark, {"other_special_notice": text}).head().other_special_notice_grade == want


def groups(spark, **message):
    made = graded(spark, message).selectExpr(f"{g.action_groups()} as g", f"{g.severity()} as s")
    row = made.selectExpr("*", f"{g.severity_of_groups('g.code')} as s2").head()
    assert row.s == row.s2
    return [x.code for x in row.g], row.s, row.g


def test_groups_and_severity_ladder(spark):
    assert groups(spark)[:2] == (["정상"], "LOW")
    assert groups(spark, pm10=200.0)[:2] == (["마스크_필수", "외출_자제"], "CRITICAL")
    assert groups(spark, pm25=600.0)[:2] == (["마스크_필수"], "HIGH")
    assert groups(spark, yellow_dust=200.0)[:2] == (["마스크_필수"], "HIGH")
    assert groups(spark, other_special_notice="낙뢰 가능")[:2] == (["특보_확인"], "HIGH")
    assert groups(spark, uv_index=7.0)[:2] == (["자외선_차단"], "MEDIUM")
    assert groups(spark, feels_like_temp=-5.0)[:2] == (["보온_필수", "수분_섭취"], "MEDIUM")
    assert groups(spark, feels_like_temp=30.0)[:2] == (["수분_섭취"], "MEDIUM")
    codes, level, made = groups(spark, uv_index=None, pm25=None)
    assert (codes, level) == (["정보부족"], "MEDIUM")
    assert made[0].reasons == ["수집 실패: pm25, uv_index"]
    assert groups(spark, pm10=100.0)[2][0].reasons == ["미세먼지: 나쁨", "초미세먼지: 좋음", "황사: 좋음"]


def test_core_missing_and_names(spark):
    df = graded(spark, {}, {"pm10": None}, {"pm10": None, "pm25": None}, EMPTY)
    got = df.selectExpr(f"{g.core_missing()} as c", f"{g.missing_names()} as m", f"{g.missing_count()} as n").collect()
    assert [r.c for r in got] == [False, False, True, True]
    assert [r.n for r in got] == [0, 1, 2, 9]
    assert got[3].m == sorted(fixed.INDICES)


def test_signature_follows_grades_not_values(spark):
    a, b, c = graded(spark, {"pm10": 10.0}, {"pm10": 20.0}, {"pm10": 100.0}).selectExpr(f"{g.signature()} as s").collect()
    assert a.s == b.s != c.s
    assert a.s.startswith("dust=좋음|feels_like_temp=좋음|oak_pollen=좋음|")
    assert "pm10=나쁨" in c.s


def test_user_rule_table(spark):
    bands = spark.createDataFrame([("x", 10.0, "LOW", "-", "-"), ("x", 20.0, "HIGH", "-", "-")], g.BAND_TABLE_SCHEMA)
    readings = spark.createDataFrame([("x", 10.0), ("x", 10.5), ("x", 99.0), ("x", None), ("y", 1.0)], "index_name string, value double")
    got = g.grade_by_table(readings, bands).orderBy("index_name", F.col("value").asc_nulls_first()).collect()
    assert [r.grade for r in got] == ["UNKNOWN", "LOW", "HIGH", "HIGH", "UNKNOWN"]


WANT_COUNTS = {
    "dust": (1008, 241, 43, 14, 722),
    "feels_like_temp": (196, 128, 566, 378, 760),
    "oak_pollen": (801, 336, 116, 42, 733),
    "other_special_notice": (786, 0, 520, 0, 722),
    "pine_pollen": (775, 364, 113, 34, 742),
    "pm10": (584, 449, 197, 65, 733),
    "pm25": (586, 386, 250, 64, 742),
    "precipitation_probability": (604, 310, 130, 231, 753),
    "uv_index": (495, 471, 332, 593, 137),
}


def test_known_grade_counts(spark):
    rows = catalog.QUERIES["grade_counts"](spark, SF_SMALL.replace("0.001", "0.01")).collect()
    got = {(r.index_name, r.grade): r.n for r in rows}
    for index, counts in WANT_COUNTS.items():
        assert tuple(got.get((index, code), 0) for code in fixed.GRADE_LABELS) == counts
