import json

from skygauge.functions import render
from skygauge.functions.grading import action_groups
from tests.test_grading import graded


def alert(spark, message, **extra):
    base = {"region": "서울", "timestamp": "2026-07-30T12:34:00+09:00", "forecast_type": "current_conditions", "low": None, "high": None}
    base.update(extra)

    def text(v):
        return "null" if v is None else f"'{v}'"

    return render.prepare(
        graded(spark, message).selectExpr(
            "*",
            f"{action_groups()} as action_groups",
            f"{text(base['region'])} as region",
            f"{text(base['timestamp'])} as timestamp",
            f"{text(base['forecast_type'])} as forecast_type",
            f"cast({text(base['low'])} as double) as min_temperature",
            f"cast({text(base['high'])} as double) as max_temperature",
            extra.get("warnings", "cast(null as map<string,string>)") + " as data_warnings",
        )
    )


BAD = {"pm10": 82.0, "pine_pollen": 3.0, "uv_index": None, "feels_like_temp": 24.06}


def test_short_text(spark):
    text = alert(spark, BAD, low="18", high="24.5").selectExpr(f"{render.short_text()} as t").head().t
    assert text.split("\n") == [
        "[서울 현재 기상 알림] 12:34", "", "행동",
        "- KF94/KF99 마스크 착용 필수", "- 마스크 착용, 외출 후 세안, 창문 닫기 권고", "", "위험/주의",
        "- 꽃가루 소나무 3: 나쁨", "- 미세먼지 PM10 82㎍/㎥: 나쁨", "- 체감온도 24.1℃: 나쁨", "", "나머지",
        "기온 최저 18℃, 최고 24.5℃", "미세먼지 나쁨, 초미세먼지 좋음", "황사 좋음, 강수확률 0%, 자외선 정보없음", "특보 없음",
    ]
    calm = alert(spark, {}, timestamp="short", forecast_type="x").selectExpr(f"{render.short_text()} as t").head().t
    assert calm.split("\n")[0] == "[서울 오늘 기상 예보 알림] 오늘"
    assert "- 특별 조치 없음" in calm and "- 대부분 좋음" in calm


def test_short_text_is_cut_to_characters(spark):
    text = alert(spark, {"other_special_notice": "가" * 3000}).selectExpr(f"{render.short_text()} as t").head().t
    assert len(text) == 1000


def test_display_rows(spark):
    rows = render.display_rows(alert(spark, BAD), ["region"]).collect()
    assert [r.position for r in rows] == list(range(9))
    assert (rows[2].label, rows[2].value, rows[2].grade, rows[2].advice) == ("미세먼지 PM10", "82㎍/㎥", "나쁨", "마스크 착용 권고 | 실외활동 최소화")
    assert rows[8].value == rows[8].grade == "정보없음"


def test_webhook_payload_is_json(spark):
    p = json.loads(alert(spark, {**BAD, "pm10": 160.0}).selectExpr(f"{render.webhook_payload()} as p").head().p)
    head, tail = p["attachments"]
    assert head["color"] == "#ff0000" and head["ts"] == 1785382440
    assert len(head["fields"]) == 8 and head["fields"][2] == {"title": "미세먼지", "value": "160.0 (매우나쁨)", "short": True}
    assert tail["text"].startswith("• 마스크_필수: ")
    calm = json.loads(alert(spark, {}).selectExpr(f"{render.webhook_payload()} as p").head().p)
    assert calm["attachments"][0]["color"] == "#36a64f" and calm["attachments"][1]["text"].startswith("✅")


def test_long_text_and_escaped_html(spark):
    df = alert(spark, {**BAD, "other_special_notice": "<b>강풍</b>"}, warnings="map('air_quality', 'x < y & z')", low="18")
    r = df.selectExpr(f"{render.subject()} as s", f"{render.long_text()} as t", f"{render.long_html()} as h").head()
    assert r.s == "[현재 기상 알림] 서울 행동 권고"
    lines = r.t.split("\n")
    assert lines[:4] == ["서울 현재 기상 알림", "수집시각: 2026-07-30T12:34:00+09:00", "", "필요한 행동"]
    assert "- 마스크_필수: KF94/KF99 마스크 착용 필수 (미세먼지: 나쁨, 초미세먼지: 좋음, 황사: 좋음)" in lines
    assert "오늘 기온: 최저 18℃ / 최고 정보없음" in lines
    assert lines[-2:] == ["참고", "- air_quality: x < y & z"]
    assert "<b>강풍</b>" not in r.h and "&lt;b&gt;강풍&lt;/b&gt;" in r.h and "x &lt; y &amp; z" in r.h
    calm = alert(spark, {}).selectExpr(f"{render.long_text()} as t").head().t
    assert "참고" not in calm and "- 모든 지수가 정상범위입니다." in calm
