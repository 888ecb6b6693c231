"""Scalar rules on single values: numbers, times, keys, masking and display texts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.text import listed, number, quote

# What Python's float() reads: digits with single underscores, a point, an exponent, inf and nan.
# Spark's own cast is wider (`1.5d`) and narrower (`1_000`), so text is matched before casting.
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = (
    rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
)
_SPECIAL = r"(?i)^[+-]?(?:inf|infinity|nan)$"
_ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def safe_float(text: str, default: float | None = None) -> str:
    """SQL: text to double; null, empty, the marker `-` and unreadable text become `default`."""
    bare = f"btrim({text}, ' \\t\\n\\r\\u000b\\u000c')"
    value = (
        f"try_cast(case when {bare} rlike {quote(_NUMBER)} then replace({bare}, '_', '')"
        f" when {bare} rlike {quote(_SPECIAL)} then {bare} end as double)"
    )
    return value if default is None else f"coalesce({value}, {number(default)})"


def round_1dp(value: str) -> str:
    """SQL: round to one decimal on the exact binary value, ties to even.

    20x = 16x + 4x with both products exact, so `err` tells on which side of a decimal tie the
    double really lies. Spark's `round`/`bround` work on the shortest decimal text instead.
    """
    big, small = f"(({value}) * 16.0D)", f"(({value}) * 4.0D)"
    total = f"({big} + {small})"
    err = f"({small} - ({total} - {big}))"
    low = f"floor({total} / 2)"
    part = f"({total} / 2 - {low})"
    up = f"({part} > 0.5D or ({part} = 0.5D and ({err} > 0 or ({err} = 0 and pmod({low}, 2) = 1))))"
    return (
        f"case when isnan({value}) or abs({value}) > 1e15D then {value}"
        f" else cast({low} + if({up}, 1, 0) as double) / 10.0D end"
    )


def mean_1dp(total: str, scale: int, count: str) -> str:
    """SQL: mean of `count` values given their exact sum in 1/scale units, one decimal.

    One correctly rounded division of integers: the result does not depend on the order in which
    partitions were summed.
    """
    mean = f"(cast({total} as double) / cast({count} * {scale} as double))"
    return f"case when {count} > 0 then {round_1dp(mean)} end"


def scaled_units(value: str, scale: int) -> str:
    """SQL: value in whole 1/scale units, as a decimal so that sums are exact and cannot overflow; null if it has none."""
    return f"try_cast(round(({value}) * {number(scale)}, 0) as decimal(20,0))"


def float_text(value: str) -> str:
    """SQL: a double in the notation of message texts: no exponent from 0.0001 up to 10^16, at least one decimal.

    The digits are those of Spark's cast, which writes an exponent from 10^7 on already.
    """
    text = f"cast({value} as string)"
    decimal = f"cast(try_cast({text} as decimal(38,21)) as string)"
    plain = f"regexp_replace(regexp_replace({decimal}, '0+$', ''), '[.]$', '.0')"
    power = f"cast(substring_index({text}, 'E', -1) as int)"
    mantissa = f"regexp_replace(substring_index({text}, 'E', 1), '[.]0$', '')"
    return (
        f"case when {value} is null then null when isnan({value}) then 'nan'"
        f" when abs({value}) = double('inf') then if({value} < 0, '-inf', 'inf')"
        f" when {text} not like '%E%' then {text}"
        f" when abs({value}) >= 1e-4D and abs({value}) < 1e16D then {plain}"
        f" else concat({mantissa}, 'e', if({power} < 0, '-', '+'), format_string('%02d', abs({power}))) end"
    )


def display_value(value: str, unit: str = "", is_text: bool = False) -> str:
    """SQL: value for people: unknown when absent, at most one decimal, unit appended."""
    if is_text:
        shown = f"nullif(nullif({value}, ''), 'None')"
    else:
        shown = f"concat(regexp_replace(format_string('%.1f', {round_1dp(value)}), {quote(chr(92) + '.0$')}, ''), {quote(unit)})"
    return f"case when {value} is null then {quote(fixed.NOTICE_UNKNOWN)} else coalesce({shown}, {quote(fixed.NOTICE_UNKNOWN)}) end"


def evaluate_once(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add SQL columns through a one-row generator.

    Catalyst copies a projected expression into every filter it pushes down and may copy it into later
    projections. A generator is not looked through, so a costly parse runs once per row.
    """
    made = listed(f"{c} as {n}" for n, c in columns.items())
    return df.selectExpr("*", f"inline(array(struct({made})))")


# -- time -----------------------------------------------------------------------------------------


def utc_suffix(timestamp: str) -> str:
    """SQL: a trailing `Z` written as `+00:00`."""
    return f"regexp_replace({timestamp}, 'Z$', '+00:00')"


def zoned_instant(text: Column) -> Column:
    """TIMESTAMP of ISO text that carries an offset; zone-less or unreadable text gives null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d.*" + _ZONED), F.try_to_timestamp(text))


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def latency_seconds(published: Column, processed: Column) -> Column:
    """Seconds from the published ISO text to the processing instant, to the millisecond (ties to even)."""
    micros = micros_between(zoned_instant(published), processed)
    return F.bround(micros, -3) / F.lit(1e6)


def kst_wall(instant: Column) -> Column:
    """Local wall time in Korea of an instant, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("Asia/Seoul"), instant.cast("timestamp_ntz"))


def kst_of_utc(wall: Column) -> Column:
    """Korean wall time of a zone-less UTC wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), wall)


def event_id(region: Column, slot_wall: Column) -> Column:
    """Key of a scheduled slot: the same for every retry of the slot."""
    return F.concat(region, F.lit(":"), F.date_format(slot_wall, "yyyyMMddHH"))


def month_key(timestamp_text: Column) -> Column:
    """`YYYY.MM` of a timestamp as written, in its own offset; `unknown` for text without a month."""
    dated = timestamp_text.rlike(r"^\d{4}-\d\d")
    return F.when(dated, F.translate(F.substring(timestamp_text, 1, 7), "-", ".")).otherwise("unknown")


def slot_hour(now_wall: Column, hours: Sequence[int], delay_minutes: int) -> Column:
    """Latest publication hour in `hours` that is at least `delay_minutes` old, as wall time.

    Closed form: shift by the delay, take the largest allowed hour not after it, else the largest
    allowed hour of the day before.
    """
    shifted = now_wall - F.expr(f"INTERVAL {int(delay_minutes)} MINUTES")
    ordered = sorted(set(hours))
    hour = F.hour(shifted)
    picked = F.lit(ordered[-1] - 24)
    for candidate in ordered:
        picked = F.when(hour >= candidate, F.lit(candidate)).otherwise(picked)
    # CASE tests run from the largest hour down because each loop turn wraps the one before.
    midnight = F.date_trunc("day", shifted).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(hours=picked)


_WINDOW_DAYS = {"d": 1.0, "h": 1 / 24, "m": 1 / 1440, "w": 7.0}


def lookback_days(text: str) -> float:
    """`7`, `7d`, `24h`, `90m` (minutes) or `2w` as days."""
    spec = f"{text}d" if text[-1].isdigit() else text
    if spec[-1] not in _WINDOW_DAYS:
        raise ValueError(f"unknown lookback: {text!r}")
    return float(spec[:-1]) * _WINDOW_DAYS[spec[-1]]


def lookback_interval(text: str) -> Column:
    seconds = round(lookback_days(text) * 86400)
    return F.expr(f"INTERVAL {seconds} SECONDS")


# -- masking --------------------------------------------------------------------------------------


MaskRule = tuple[str, str] | tuple[str, str, Sequence[str]]


def mask_secrets(text: Column, extra_rules: Iterable[MaskRule] = (), rules: Iterable[MaskRule] | None = None) -> Column:
    """Replace secret values, keeping their names; later rules see the output of earlier ones.

    A rule may name words (lower case), one of which every match contains. When all rules do, texts
    without any of these words skip the regular expressions: most of them, at the price of a plain
    search. Masking only removes values, so it cannot bring a word in.
    """
    chain = [*(fixed.MASK_RULES if rules is None else rules), *extra_rules]
    masked = text
    for pattern, mask, *_ in chain:
        masked = F.regexp_replace(masked, f"(?i){pattern}", f"$1{mask}")
    if any(len(rule) < 3 for rule in chain):
        return masked
    words = sorted({word for rule in chain for word in rule[2]})
    lowered = F.lower(text)
    return F.when(reduce(Column.__or__, [F.contains(lowered, F.lit(w)) for w in words]), masked).otherwise(text)


def mask_text_columns(df: DataFrame, extra_rules: Iterable[MaskRule] = ()) -> DataFrame:
    """Mask every string column of a table; other columns pass unchanged."""
    extra = list(extra_rules)
    return df.withColumns(
        {name: mask_secrets(F.col(name), extra) for name, kind in df.dtypes if kind == "string"}
    )
