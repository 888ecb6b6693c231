# Fixed values. These must be equal to the values users rely on today: grade labels, threshold
# bands with their advice, action groups, alarm limits, display texts and masking patterns.

# -- grades ---------------------------------------------------------------------------------
GRADE_LABELS = {
    "GOOD": "좋음",
    "NORMAL": "보통",
    "BAD": "나쁨",
    "VERY_BAD": "매우나쁨",
    "UNKNOWN": "정보없음",
}
UNKNOWN_ADVICE = "데이터 수집 실패로 판정할 수 없음"
UNKNOWN_ICON = "❔"

# The nine graded indices in message order. `dust` arrives as `yellow_dust`.
INDICES = (
    "oak_pollen",
    "pine_pollen",
    "pm10",
    "pm25",
    "dust",
    "feels_like_temp",
    "other_special_notice",
    "precipitation_probability",
    "uv_index",
)

# (upper bound, grade, advice, icon): the first band with value <= bound; above all, the last one.
_POLLEN_BANDS = (
    (1, "GOOD", "꽃가루 위험 낮음 | 일상활동 가능", "😊"),
    (2, "NORMAL", "알레르기 민감군 주의 | 외출 후 세안 권고", "😐"),
    (3, "BAD", "마스크 착용 권고 | 창문 닫기 | 외출 후 의류 털기", "😷"),
    (4, "VERY_BAD", "알레르기 민감군 외출 자제 | 실내 공기관리 권고", "⚠️"),
)
BANDS = {
    "oak_pollen": _POLLEN_BANDS,
    "pine_pollen": _POLLEN_BANDS,
    "pm10": (
        (30, "GOOD", "외출 자유 | 창문 개방 좋음", "😊"),
        (80, "NORMAL", "민감군(어린이, 노약자) 실외활동 제한 권고", "😐"),
        (150, "BAD", "마스크 착용 권고 | 실외활동 최소화", "😷"),
        (500, "VERY_BAD", "외출 자제 필수 | KF94 마스크 필수 | 외출 최소화", "⚠️"),
    ),
    "pm25": (
        (15, "GOOD", "외출 자유 | 창문 개방 좋음", "😊"),
        (35, "NORMAL", "민감군 주의 | 마스크 착용 권고", "😐"),
        (75, "BAD", "마스크 착용 필수 | 실외활동 최소화", "😷"),
        (500, "VERY_BAD", "외출 자제 | KF94/KF99 마스크 필수 | 외출 금지", "⚠️"),
    ),
    "dust": (
        (150, "GOOD", "외출 자유", "😊"),
        (300, "NORMAL", "민감군 마스크 착용 | 창문 닫기 권고", "😐"),
        (500, "BAD", "마스크 착용 필수 | 외출 최소화 | 창문 닫기", "😷"),
        (10000, "VERY_BAD", "외출 금지 | 실내 활동만 | 공기청정기 가동 | 환기 금지", "⚠️"),
    ),
    "feels_like_temp": (
        (0, "VERY_BAD", "매우 추운 날 | 동상 위험 | 내복 + 외투 + 장갑 필수", "❄️"),
        (5, "BAD", "추운 날 | 두터운 외투 필수 | 모자, 장갑, 목도리 필수", "😷"),
        (10, "NORMAL", "쌀쌀함 | 얇은 외투 + 내복 권고", "😐"),
        (20, "GOOD", "쾌적한 온도 | 편한 복장", "😊"),
        (100, "BAD", "더운 날 | 얇은 복장 | 수분 섭취 | 외출 최소화", "🌡️"),
    ),
    "precipitation_probability": (
        (30, "GOOD", "우산 없이 활동 가능", "😊"),
        (60, "NORMAL", "우산 준비 권고", "😐"),
        (80, "BAD", "우산 필요 | 이동 시 비 대비", "☔"),
        (100, "VERY_BAD", "강수 가능성 높음 | 외출 계획 조정 권고", "⚠️"),
    ),
    "uv_index": (
        (2, "GOOD", "자외선 차단 불필요 | 야외활동 자유", "😊"),
        (5, "NORMAL", "선크림 SPF30+ 권장 | 모자 쓰기 좋음", "😐"),
        (7, "BAD", "선크림 SPF50+ 필수 | 자외선 차단 의류 착용 | 야외 활동 최소화", "😷"),
        (20, "VERY_BAD", "정오(10시-3시) 외출 자제 | 선크림 2시간마다 재도포 | 자외선 차단복 필수", "⚠️"),
    ),
}
NOTICE_NONE = "없음"
NOTICE_UNKNOWN = "정보없음"
NOTICE_GOOD = ("GOOD", "특보성 신호 없음", "😊")
NOTICE_BAD = ("BAD", "특보성 신호 확인 | 최신 기상정보 확인 권고", "⚠️")

# -- action groups, in activation order -------------------------------------------------------
MASK, STAY_IN, SUNSCREEN, ALLERGY = "마스크_필수", "외출_자제", "자외선_차단", "알레르기_주의"
UMBRELLA, NOTICE, WARMTH, HYDRATION = "우산_준비", "특보_확인", "보온_필수", "수분_섭취"
INSUFFICIENT, ALL_NORMAL = "정보부족", "정상"
GROUP_ACTIONS = {
    MASK: "KF94/KF99 마스크 착용 필수",
    STAY_IN: "가급적 외출 자제, 부득이한 경우만 외출",
    SUNSCREEN: "선크림 SPF50+ 필수, 자외선 차단 의류 착용",
    ALLERGY: "마스크 착용, 외출 후 세안, 창문 닫기 권고",
    UMBRELLA: "우산 또는 우비 준비",
    NOTICE: "최신 기상특보와 외출 안전 확인",
    WARMTH: "내복, 외투, 장갑, 목도리 필수",
    HYDRATION: "충분한 수분 섭취, 가볍고 통풍 좋은 옷 착용",
    INSUFFICIENT: "수집 실패 항목은 기상청·에어코리아에서 직접 확인 권고",
    ALL_NORMAL: "특별 조치 없음",
}
REASON_LABELS = {
    "pm10": "미세먼지",
    "pm25": "초미세먼지",
    "dust": "황사",
    "uv_index": "자외선 지수",
    "oak_pollen": "꽃가루 참나무",
    "pine_pollen": "꽃가루 소나무",
    "precipitation_probability": "강수확률",
    "other_special_notice": "기타특보",
    "feels_like_temp": "체감온도",
}
INSUFFICIENT_REASON = "수집 실패: "
ALL_NORMAL_REASON = "모든 지수가 정상범위"

# -- message contract -------------------------------------------------------------------------
SCHEMA_VERSION = 1
REQUIRED_KEYS = ("event_id", "timestamp", "region")
CONTRACT_INDICES = (
    "oak_pollen",
    "pine_pollen",
    "pm10",
    "pm25",
    "yellow_dust",
    "feels_like_temp",
    "precipitation_probability",
    "uv_index",
    "other_special_notice",
)

# -- portal payloads --------------------------------------------------------------------------
DAY_KEYS = ("today", "tomorrow", "dayaftertomorrow", "twodaysaftertomorrow")
POLLUTANTS = ("pm10", "pm25", "o3", "no2", "so2", "co")
SIGNAL_LIGHTNING, SIGNAL_WIND, SIGNAL_RAIN = "낙뢰 가능", "강풍 가능", "강수 가능"
TODAY_PREFIX = "오늘 "
ADVISORY_ISSUED, ADVISORY_NONE = "발생", "없음"
ADVISORY_DUST, ADVISORY_CLEAR = 500.0, 0.0
# publication hours and delay in minutes of each feed
SLOT_RULES = {
    "index": ((6, 18), 30),
    "short_range": ((2, 5, 8, 11, 14, 17, 20, 23), 10),
    "observed": (tuple(range(24)), 10),
    "ultra_short": (tuple(range(24)), 45),
}
WARN_AIR = "대기질 데이터 없음"
WARN_DUST = "황사 발생정보 데이터 없음"
WARN_LIVING = "생활기상지수 데이터 없음"
WARN_LIVING_CURRENT = "생활기상지수 API 응답 없음, 초단기실황 기온으로 대체"
WARN_LIVING_DAILY = "생활기상지수 API 응답 없음, 오늘 최고 예보 기온으로 대체"
WARN_TEMPERATURE = "초단기실황 기온 없음, 생활기상지수 값으로 대체"
WARN_UV = "자외선지수 데이터 없음"
WARN_TODAY = "오늘 단기예보 요약 데이터 없음"

# -- masking: (pattern, replacement, words one of which must be there) in order, case-insensitive --
MASK_RULES = (
    (r"""(serviceKey=)[^&\s"'<>]+""", "***", ("servicekey=",)),
    (
        r"""((?:access_token|refresh_token|client_secret|rest_api_key|api_key|password)"""
        r"""["']?\s*[:=]\s*["']?)[^\s,&}"']+""",
        "***",
        ("access_token", "refresh_token", "client_secret", "api_key", "password"),
    ),
    (r"""(Bearer\s+)[\w.\-]+""", "***", ("bearer",)),
)

# -- display ----------------------------------------------------------------------------------
CHANNELS = ("slack", "email", "kakao")
DISPLAY_ROWS = (
    ("oak_pollen", "꽃가루 참나무", ""),
    ("pine_pollen", "꽃가루 소나무", ""),
    ("pm10", "미세먼지 PM10", "㎍/㎥"),
    ("pm25", "초미세먼지 PM2.5", "㎍/㎥"),
    ("dust", "황사", "㎍/㎥"),
    ("feels_like_temp", "체감온도", "℃"),
    ("other_special_notice", "기타특보", ""),
    ("precipitation_probability", "강수확률", "%"),
    ("uv_index", "자외선지수", ""),
)
TITLES = {
    "current_conditions": "현재 기상 알림",
    "morning_mixed": "오늘 아침 기상 알림",
    "daily_full_forecast": "오늘 전체 예보 알림",
}
TITLE_DEFAULT = "오늘 기상 예보 알림"
WEBHOOK_FIELDS = (
    ("oak_pollen", "꽃가루 참나무"),
    ("pine_pollen", "꽃가루 소나무"),
    ("pm10", "미세먼지"),
    ("pm25", "초미세먼지"),
    ("dust", "황사"),
    ("feels_like_temp", "체감온도"),
    ("other_special_notice", "기타특보"),
    ("precipitation_probability", "강수확률"),
    ("uv_index", "자외선"),
)
COLOR_DANGER, COLOR_CAUTION, COLOR_CALM = "#ff0000", "#ff6600", "#36a64f"

# -- limits -----------------------------------------------------------------------------------
MAX_SILENCE_SECONDS = 12 * 3600
RETENTION_DAYS = 90
REGRESS_P95_PCT = 50.0
MIN_INDEX_RATE = 0.98
MAX_REPORT_LAG = 10
ALARM_LOOKBACK_MINUTES = 70
ALARM_COOLDOWN_MINUTES = 60
ALARM_LAG = 4
ALARM_NO_HISTORY_HOURS = 7
ALARM_HITS = 20
ALARM_EVENT_IDS = 5
ALARM_FIELDS = ("event_id", "region", "missing_indices", "missing_count", "cluster_status")
FIRST_RUN = "첫 회차 — 비교 대상 없음"
NO_REGRESSION = "회귀 없음"

# -- message texts ----------------------------------------------------------------------------
TEXT_ACTIONS, TEXT_RISKS, TEXT_REST = "행동", "위험/주의", "나머지"
TEXT_NO_ACTION = "특별 조치 없음"
TEXT_MOSTLY_GOOD = "- 대부분 좋음"
TEXT_TIME_UNKNOWN = "오늘"
SHORT_TEXT_LIMIT = 1000
LONG_COLLECTED_AT, LONG_ACTIONS, LONG_DETAILS, LONG_NOTES = "수집시각: ", "필요한 행동", "상세 판정", "참고"
LONG_ALL_NORMAL = "모든 지수가 정상범위입니다."
LONG_TEMPERATURES = ("오늘 기온: 최저 ", " / 최고 ")
SHORT_TEMPERATURES = ("기온 최저 ", ", 최고 ")
LONG_HEADERS = ("항목", "값", "등급", "권고")
SUBJECT_SUFFIX = " 행동 권고"
WEBHOOK_NAME, WEBHOOK_TITLE = "기상지수 알림봇", " 기상지수 알림"
WEBHOOK_ICON, WEBHOOK_FOOTER = ":weather_cloud:", "기상청/에어코리아 기반 예측"
WEBHOOK_ACTIONS = "⚡ 필요한 행동"
WEBHOOK_ALL_NORMAL = "✅ 모든 지수가 정상범위입니다."
ALARM_TITLES = {
    "a": ("신규 이력 없음 (", "시간)"),
    "b": ("전달 실패 ", "건"),
    "c": ("결측 발생 ", "건"),
    "d": ("컨슈머 랙 ", f" (> {ALARM_LAG})"),
    "g": ("OpenSearch 클러스터 ", ""),
}
