"""Shared SQL fragments: the test views restated for the comparison engine."""

from __future__ import annotations

from skygauge import fixed

EV = """ev AS (
  SELECT *, 'R' || lpad(CAST(user_id % 17 AS VARCHAR), 2, '0') AS region,
         time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS slot,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

MSG = f"""{EV}, msg0 AS (
  SELECT region, slot, max(ts) AS ts, max(event_id) AS msg_offset,
    CAST(min(user_id % 17) % 4 AS INTEGER) AS msg_partition,
    arg_max(value, ts) FILTER (event_type = 'click') AS pm10,
    arg_max(value, ts) FILTER (event_type = 'view') / 2 AS pm25,
    arg_max(value, ts) FILTER (event_type = 'error') * 2 AS dust,
    arg_max(value, ts) FILTER (event_type = 'signup') / 2 - 10 AS feels_like_temp,
    arg_max(CASE WHEN value > 100 THEN 100.0::DOUBLE ELSE value END, ts) FILTER (event_type = 'purchase') AS precipitation_probability,
    CAST(nullif(arg_max(k, ts) % 13, 12) AS DOUBLE) AS uv_index,
    CAST(nullif(count(*) FILTER (event_type = 'click'), 0) AS DOUBLE) AS oak_pollen,
    CAST(nullif(count(*) FILTER (event_type = 'view'), 0) AS DOUBLE) AS pine_pollen,
    CASE WHEN count(*) FILTER (event_type = 'error') >= 2 THEN '강풍 가능'
         WHEN count(*) FILTER (event_type = 'error') = 1 THEN '없음' ELSE '정보없음' END AS other_special_notice
  FROM ev GROUP BY region, slot),
msg AS (
  SELECT *, region || ':' || strftime(slot, '%Y%m%d%H') AS event_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS stamp
  FROM msg0)"""


def _case(index: str, field: int) -> str:
    if index == "other_special_notice":
        unknown = (None, "UNKNOWN", fixed.UNKNOWN_ADVICE)[field]
        good, bad = fixed.NOTICE_GOOD[field - 1], fixed.NOTICE_BAD[field - 1]
        return (
            f"CASE WHEN {index} IS NULL OR {index} IN ('', '정보없음') THEN '{unknown}'"
            f" WHEN {index} = '없음' THEN '{good}' ELSE '{bad}' END"
        )
    return band_case(index, index, field)


def band_case(index: str, column: str, field: int = 1) -> str:
    unknown = (None, "UNKNOWN", fixed.UNKNOWN_ADVICE)[field]
    bands = fixed.BANDS[index]
    whens = " ".join(f"WHEN {column} <= {b[0]} THEN '{b[field]}'" for b in bands)
    return f"CASE WHEN {column} IS NULL THEN '{unknown}' {whens} ELSE '{bands[-1][field]}' END"


def graded(messages: str) -> str:
    cases = ", ".join(f"{_case(i, 1)} AS {i}_grade, {_case(i, 2)} AS {i}_advice" for i in fixed.INDICES)
    return f"graded AS (SELECT *, {cases} FROM {messages})"


GRADED = f"{MSG}, {graded('msg')}"

# One message per event, as the raw records of `views.event_records` carry it.
EVENT_MSG = f"""{EV}, emsg AS (
  SELECT 'E' || event_id AS event_id, event_id AS msg_offset, region, ts,
    CASE WHEN event_type = 'click' THEN value WHEN k % 2 = 0 THEN k::DOUBLE END AS pm10,
    CASE WHEN event_type = 'view' THEN value / 2 WHEN k % 3 = 0 THEN (k / 2)::DOUBLE END AS pm25,
    CASE WHEN event_type = 'error' THEN value * 2 END AS dust,
    CASE WHEN event_type = 'signup' THEN value / 2 - 10 END AS feels_like_temp,
    CASE WHEN event_type = 'purchase' THEN value END AS precipitation_probability,
    (k % 13)::DOUBLE AS uv_index, (k % 5)::DOUBLE AS oak_pollen, (k % 4)::DOUBLE AS pine_pollen,
    CASE WHEN k % 7 = 0 THEN '강풍 가능' WHEN k % 7 < 4 THEN '없음' ELSE '정보없음' END AS other_special_notice
  FROM ev WHERE event_id % 41 <> 0)"""


def label(code: str) -> str:
    whens = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in fixed.GRADE_LABELS.items())
    return f"CASE {code} {whens} END"


def labelled(index: str) -> str:
    return label(f"{index}_grade")


_BAD = "IN ('BAD', 'VERY_BAD')"
FLAGS = {
    fixed.MASK: f"pm10_grade {_BAD} OR pm25_grade {_BAD} OR dust_grade IN ('NORMAL', 'BAD', 'VERY_BAD')",
    fixed.STAY_IN: "pm10_grade = 'VERY_BAD' OR dust_grade = 'VERY_BAD'",
    fixed.SUNSCREEN: f"uv_index_grade {_BAD}",
    fixed.ALLERGY: f"oak_pollen_grade {_BAD} OR pine_pollen_grade {_BAD}",
    fixed.UMBRELLA: f"precipitation_probability_grade {_BAD}",
    fixed.NOTICE: f"other_special_notice_grade {_BAD}",
    fixed.WARMTH: "feels_like_temp_grade = 'VERY_BAD'",
    fixed.HYDRATION: f"feels_like_temp_grade {_BAD}",
}
REASONS = {
    fixed.MASK: ("pm10", "pm25", "dust"),
    fixed.STAY_IN: ("pm10", "dust"),
    fixed.SUNSCREEN: ("uv_index",),
    fixed.ALLERGY: ("oak_pollen", "pine_pollen"),
    fixed.UMBRELLA: ("precipitation_probability",),
    fixed.NOTICE: ("other_special_notice",),
    fixed.WARMTH: ("feels_like_temp",),
    fixed.HYDRATION: ("feels_like_temp",),
}
MISSING = "concat_ws('{sep}', " + ", ".join(
    f"CASE WHEN {i}_grade = 'UNKNOWN' THEN '{i}' END" for i in sorted(fixed.INDICES)
) + ")"
MISSING_COUNT = " + ".join(f"CAST({i}_grade = 'UNKNOWN' AS INTEGER)" for i in fixed.INDICES)


def missing(sep: str = "|") -> str:
    return MISSING.replace("{sep}", sep)


def _reasons(group: str) -> str:
    return " || ', ' || ".join(f"'{fixed.REASON_LABELS[i]}: ' || {labelled(i)}" for i in REASONS[group])


_ACTIVE = " OR ".join(f"({f})" for f in FLAGS.values())


def groups(render) -> str:
    """Active groups joined by `|`; `render(code, action, reasons)` gives the SQL text of one."""
    active = "concat_ws('|', " + ", ".join(
        f"CASE WHEN {FLAGS[g]} THEN {render(g, fixed.GROUP_ACTIONS[g], _reasons(g))} END" for g in FLAGS
    ) + ")"
    lacking = f"'{fixed.INSUFFICIENT_REASON}' || {missing(', ')}"
    none = render(fixed.INSUFFICIENT, fixed.GROUP_ACTIONS[fixed.INSUFFICIENT], lacking)
    normal = render(fixed.ALL_NORMAL, fixed.GROUP_ACTIONS[fixed.ALL_NORMAL], f"'{fixed.ALL_NORMAL_REASON}'")
    return f"CASE WHEN {_ACTIVE} THEN {active} WHEN {MISSING_COUNT} > 0 THEN {none} ELSE {normal} END"


SEVERITY = (
    f"CASE WHEN {FLAGS[fixed.STAY_IN]} THEN 'CRITICAL'"
    f" WHEN {FLAGS[fixed.MASK]} OR {FLAGS[fixed.NOTICE]} THEN 'HIGH'"
    f" WHEN NOT ({_ACTIVE}) AND {MISSING_COUNT} = 0 THEN 'LOW' ELSE 'MEDIUM' END"
)
SIGNATURE = " || '|' || ".join(f"'{i}=' || {labelled(i)}" for i in sorted(fixed.INDICES))
COARSE = "CASE WHEN pm10 IS NULL THEN 'U' WHEN pm10 <= 80 THEN 'L' ELSE 'H' END"
CORE = "(pm10 IS NULL AND pm25 IS NULL)"


def gate(rows: str, silence_seconds: int = 43200) -> str:
    """Recursive statement of the send gate over `rows(region, o, clock, sig, core, ok, enabled)`.

    Gives the CTEs `g0` (numbered rows) and `gate` with send, recorded and the state after each row.
    """
    return f"""g0 AS (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY o) AS rn FROM ({rows})),
walk AS (
  SELECT DISTINCT region, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BOOLEAN) AS send,
         CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS psig, CAST(NULL AS TIMESTAMP) AS plast
  FROM g0
  UNION ALL
  SELECT region, rn, o, send, reason,
         CASE WHEN NOT send OR ok OR NOT enabled THEN sig ELSE psig END,
         CASE WHEN send AND ok THEN clock ELSE plast END
  FROM (
    SELECT n.region, n.rn, n.o, n.ok, n.enabled, n.sig, n.clock, w.psig, w.plast,
      NOT n.core AND (w.psig IS NULL OR w.psig <> n.sig
        OR coalesce(epoch_us(n.clock) - epoch_us(w.plast) >= {silence_seconds}000000, false)) AS send,
      CASE WHEN n.core THEN 'core_missing' WHEN w.psig IS NULL OR w.psig <> n.sig THEN 'change'
           WHEN epoch_us(n.clock) - epoch_us(w.plast) >= {silence_seconds}000000 THEN 'heartbeat'
           ELSE 'suppressed' END AS reason
    FROM walk w JOIN g0 n ON n.region = w.region AND n.rn = w.rn + 1)),
gate AS (
  SELECT g.*, w.send, w.reason, (NOT w.send OR NOT g.enabled OR g.ok) AS recorded, w.psig, w.plast
  FROM walk w JOIN g0 g ON g.region = w.region AND g.rn = w.rn)"""


GATE_ROWS = (
    f"SELECT region, msg_offset AS o, ts AS clock, {COARSE} AS sig, {CORE} AS core,"
    " msg_offset % 5 <> 0 AS ok, true AS enabled, event_id FROM msg"
)
FULL_GATE_ROWS = (
    f"SELECT region, msg_offset AS o, ts AS clock, {SIGNATURE} AS sig, {CORE} AS core,"
    " msg_offset % 5 <> 0 AS ok, true AS enabled, event_id FROM graded"
)
ORDER_GATE_ROWS = """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'HOT' ELSE 'C' || (o_custkey % 23) END AS region,
  o_orderkey AS o, o_orderdate AS clock,
  CASE WHEN o_totalprice > 480000 THEN 'H' WHEN o_totalprice < 10000 THEN 'U' ELSE 'L' END AS sig,
  o_totalprice < 5000 AS core, o_orderkey % 7 <> 0 AS ok, o_orderstatus <> 'P' AS enabled FROM orders"""


def rounded(x: str) -> str:
    """One decimal on the exact binary value, ties to even (same arithmetic as the Spark side)."""
    total = f"(({x}) * 16.0::DOUBLE + ({x}) * 4.0::DOUBLE)"
    err = f"((({x}) * 4.0::DOUBLE) - ({total} - (({x}) * 16.0::DOUBLE)))"
    low = f"floor({total} / 2)"
    part = f"({total} / 2 - {low})"
    up = f"({part} > 0.5 OR ({part} = 0.5 AND ({err} > 0 OR ({err} = 0 AND {low} % 2 <> 0))))"
    return f"(({low} + CAST({up} AS INTEGER)) / 10.0::DOUBLE)"


EVENT_METRICS = f"""{EV}, em AS (
  SELECT region || '#' || event_id AS event_id, region, ts AS processed_at,
    round_even(value * 10, 0) / 10 AS process_duration_ms,
    CASE WHEN event_id % 97 <> 0 THEN ((event_id * 7919) % 22000) / 1000.0::DOUBLE END AS e2e_latency_seconds,
    event_id % 3 <> 0 AS external_attempted,
    event_id % 3 <> 0 AND event_id % 5 = 0 AS delivery_failed,
    event_id % 3 = 0 AS suppressed,
    CASE k % 10 WHEN 0 THEN ['pm10', 'pm25'] WHEN 1 THEN ['uv_index'] ELSE [] END AS missing_indices,
    CASE k % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS missing_count,
    event_id % 50 <> 0 AS indexed
  FROM ev)"""
