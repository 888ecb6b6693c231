import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skygauge.functions import scalars as s


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_safe_float_reads_what_float_reads(spark):
    texts = [
        None, "", "-", " ", "1.5", " 1.5 ", "\t2\n", "1_000", "1__0", "_1", "1.", ".5", ".", "1e3", "1E-2", "1e", "+3", "-4.25",
        "1.5d", "1.5f", "0x10", "inf", "-Infinity", "abc", "12abc", "1,5", "- ", "--1",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.selectExpr("i", f"{s.safe_float('t')} as x").collect()}
    for i, t in enumerate(texts):
        want = None
        if t not in (None, "", "-"):
            try:
                want = float(t)
            except ValueError:
                want = None
        assert got[i] == want, t
    assert one(spark, F.expr(s.safe_float("'-'", 0))) == 0.0


def test_round_1dp_equals_python(spark):
    rng = random.Random(1)
    values = [k / 20 for k in range(-400, 400)] + [rng.uniform(-1e4, 1e4) for _ in range(500)]
    values += [0.04999999999999999, 0.35, 0.25, 12.25, 12.35, 1e14 + 0.25, 2.675, 1.45]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, x in df.selectExpr("v", s.round_1dp("v")).collect():
        assert x == round(v, 1), v


def test_display_value(spark):
    def shown(value, *args):
        return one(spark, F.expr(s.display_value(value, *args)))

    values = {"100.0D": "100", "31.94D": "31.9", "0.0D": "0", "10.5D": "10.5", "cast(null as double)": "정보없음"}
    for value, want in values.items():
        assert shown(value) == want
    assert shown("20.0D", "℃") == "20℃"
    assert shown("cast(null as double)", "℃") == "정보없음"
    assert shown("'없음'", "", True) == "없음"
    assert shown("''", "", True) == "정보없음"


SLOTS = [
    ("2026-07-30 06:10:00", "index", "2026072918"),
    ("2026-07-30 06:40:00", "index", "2026073006"),
    ("2026-07-30 06:30:00", "index", "2026073006"),
    ("2026-07-30 02:05:00", "short_range", "2026072923"),
    ("2026-07-30 02:15:00", "short_range", "2026073002"),
    ("2026-07-30 00:05:00", "observed", "2026072923"),
    ("2026-07-30 00:44:59", "ultra_short", "2026072923"),
    ("2026-07-30 13:45:00", "ultra_short", "2026073013"),
]


@pytest.mark.parametrize("now,rule,want", SLOTS)
def test_publication_slots(spark, now, rule, want):
    from skygauge import fixed

    slot = s.slot_hour(F.lit(now).cast("timestamp_ntz"), *fixed.SLOT_RULES[rule])
    assert one(spark, F.date_format(slot, "yyyyMMddHH")) == want


def test_event_id_is_the_slot_in_korea(spark):
    for text in ("2026-07-30T12:00:00+09:00", "2026-07-30T03:00:00+00:00", "2026-07-30T03:00:00Z"):
        wall = s.kst_wall(s.zoned_instant(F.lit(text)))
        assert one(spark, s.event_id(F.lit("서울"), wall)) == "서울:2026073012"
    midnight = s.kst_wall(s.zoned_instant(F.lit("2026-07-29T15:00:00Z")))
    assert one(spark, s.event_id(F.lit("서울"), midnight)) == "서울:2026073000"


def test_kst_wall_ignores_the_session_zone(spark):
    df = spark.createDataFrame([("2026-07-30T03:00:00Z",)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            got = df.select(F.date_format(s.kst_wall(s.zoned_instant(F.col("t"))), "yyyyMMddHHmm")).head()[0]
            assert got == "202607301200"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_latency_needs_an_offset(spark):
    now = F.lit("2026-07-30 03:00:12.5").cast("timestamp")
    cases = {
        "2026-07-30T12:00:00+09:00": 12.5,
        "2026-07-30T03:00:00Z": 12.5,
        "2026-07-30T12:00:00": None,
        "2026-07-30": None,
        "2026": None,
        "nonsense": None,
        None: None,
    }
    for text, want in cases.items():
        assert one(spark, s.latency_seconds(F.lit(text).cast("string"), now)) == want, text


def test_month_is_taken_as_written(spark):
    assert one(spark, s.month_key(F.lit("2026-08-01T00:30:00+09:00"))) == "2026.08"


def test_lookback():
    assert s.lookback_days("7") == s.lookback_days("7d") == 7
    assert s.lookback_days("24h") == 1
    assert s.lookback_days("90m") == pytest.approx(90 / 1440)
    assert s.lookback_days("2w") == 14
    with pytest.raises(ValueError):
        s.lookback_days("3y")


MASKED = [
    ("http://x/y?serviceKey=abc%2B&x=1", "http://x/y?serviceKey=***&x=1"),
    ("http://x/y?x=1&SERVICEKEY=abc", "http://x/y?x=1&SERVICEKEY=***"),
    ('{"access_token": "abc", "refresh_token":"d"}', '{"access_token": "***", "refresh_token":"***"}'),
    ("Authorization: Bearer ab.c-d", "Authorization: Bearer ***"),
    ("client_secret=zz other", "client_secret=*** other"),
    ("PASSWORD='pw'", "PASSWORD='***'"),
    ("plain text", "plain text"),
    (None, None),
]


def test_masking(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MASKED)], "i int, t string")
    got = {r.i: r.t for r in s.mask_text_columns(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(MASKED)}
    assert one(spark, s.mask_secrets(F.lit('token = "abc"'), [(r"(token\s*=\s*\")[^\"]+", "***")])) == 'token = "***"'


def test_now_of_retention(spark):
    from skygauge.operators.delivery import retention

    now = dt.datetime(2026, 7, 1)
    df = spark.createDataFrame(
        [("a", now - dt.timedelta(days=89)), ("b", now - dt.timedelta(days=90))], "month string, created_at timestamp"
    )
    got = {r.month: r.keep for r in retention(df, F.lit(now).cast("timestamp")).collect()}
    assert got == {"a": True, "b": False}


def test_float_text_is_the_notation_of_messages(spark):
    from skygauge.functions.scalars import float_text

    draw = random.Random(4)
    values = [0.0, -0.0, 82.0, 12345678.0, 1e7, 1e15, 1e16, 1.5e16, -2.5e17, 1e-4, 0.00012345, 9.9e-5, -1e-5, 1e100, 3e-200, 1234567.25]
    values += [float("inf"), -float("inf")] + [draw.uniform(-1, 1) * 10.0 ** draw.randrange(-8, 20) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", f"{float_text('v')} as t").collect()
    assert [(r["v"], r["t"]) for r in rows if float(r["t"]) != r["v"] or len(r["t"]) == len(repr(r["v"])) and r["t"] != repr(r["v"])] == []
    assert [r["t"] for r in rows[:16]] == [repr(v) for v in values[:16]]
    odd = spark.range(1).selectExpr(f"{float_text('double(null)')} as a", f"{float_text('double(chr(78) || chr(97) || chr(78))')} as b")
    assert tuple(odd.head()) == (None, "nan")
