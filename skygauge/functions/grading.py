"""Grading rules: bands, action groups, severity, signatures and missing values.

Grades live in columns `<index>_grade` holding a code of `fixed.GRADE_LABELS`. All rules compile to
CASE expressions, so grading a message table is one narrow, code-generated stage. The builders return
SQL text (see `functions.text`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge import fixed
from skygauge.functions.text import any_of, listed, number, present, quote

GRADE, ADVICE, ICON = 1, 2, 3
_UNKNOWN = (None, "UNKNOWN", fixed.UNKNOWN_ADVICE, fixed.UNKNOWN_ICON)
Band = tuple[float, str, str, str]


def band_value(value: str, bands: Sequence[Band], field: int = GRADE) -> str:
    """Field of the first band whose bound is not below the value.

    Null is UNKNOWN. A value above every bound, or NaN, falls to the last band.
    """
    whens = " ".join(f"when {value} <= {number(b[0])} then {quote(b[field])}" for b in bands[:-1])
    return f"case when {value} is null then {quote(_UNKNOWN[field])} {whens} else {quote(bands[-1][field])} end"


def notice_value(value: str, field: int = GRADE) -> str:
    """Special notice: unknown, confirmed none, or a signal."""
    return (
        f"case when {value} is null or {value} in ('', {quote(fixed.NOTICE_UNKNOWN)}) then {quote(_UNKNOWN[field])}"
        f" when {value} = {quote(fixed.NOTICE_NONE)} then {quote(fixed.NOTICE_GOOD[field - 1])}"
        f" else {quote(fixed.NOTICE_BAD[field - 1])} end"
    )


def index_value(index: str, value: str, field: int = GRADE) -> str:
    if index == "other_special_notice":
        return notice_value(value, field)
    return band_value(value, fixed.BANDS[index], field)


def with_grades(messages: DataFrame, advice: bool = False, icon: bool = False) -> DataFrame:
    """Add `<index>_grade` (and advice, icon) for the nine indices; `yellow_dust` becomes `dust`."""
    wanted = [("grade", GRADE)] + [("advice", ADVICE)] * advice + [("icon", ICON)] * icon
    out = messages.withColumnRenamed("yellow_dust", "dust")
    return out.selectExpr(
        "*", *[f"{index_value(i, i, field)} as {i}_{name}" for i in fixed.INDICES for name, field in wanted]
    )


def label(code: str) -> str:
    """Grade code to its label; an absent code reads as unknown."""
    known = {c: t for c, t in fixed.GRADE_LABELS.items() if c != "UNKNOWN"}
    whens = " ".join(f"when {quote(c)} then {quote(t)}" for c, t in known.items())
    return f"case {code} {whens} else {quote(fixed.GRADE_LABELS['UNKNOWN'])} end"


def label_of(index: str) -> str:
    return label(f"{index}_grade")


def grades_long(graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per message and index: keys, index, value (numeric only), grade."""
    entries = listed(
        f"struct({quote(i)} as index_name,"
        f" {'cast(null as double)' if i == 'other_special_notice' else i} as value, {i}_grade as grade)"
        for i in fixed.INDICES
    )
    return graded.selectExpr(*keys, f"inline(array({entries}))")


# -- action groups --------------------------------------------------------------------------------


def _in(index: str, *codes: str) -> str:
    return f"coalesce({index}_grade in ({listed(map(quote, codes))}), false)"


def _bad(index: str) -> str:
    return _in(index, "BAD", "VERY_BAD")


def action_flags() -> dict[str, str]:
    """The eight group conditions in activation order."""
    return {
        fixed.MASK: any_of([_bad("pm10"), _bad("pm25"), _in("dust", "NORMAL", "BAD", "VERY_BAD")]),
        fixed.STAY_IN: any_of([_in("pm10", "VERY_BAD"), _in("dust", "VERY_BAD")]),
        fixed.SUNSCREEN: _bad("uv_index"),
        fixed.ALLERGY: any_of([_bad("oak_pollen"), _bad("pine_pollen")]),
        fixed.UMBRELLA: _bad("precipitation_probability"),
        fixed.NOTICE: _bad("other_special_notice"),
        fixed.WARMTH: _in("feels_like_temp", "VERY_BAD"),
        fixed.HYDRATION: _bad("feels_like_temp"),
    }


_REASON_INDICES = {
    fixed.MASK: ("pm10", "pm25", "dust"),
    fixed.STAY_IN: ("pm10", "dust"),
    fixed.SUNSCREEN: ("uv_index",),
    fixed.ALLERGY: ("oak_pollen", "pine_pollen"),
    fixed.UMBRELLA: ("precipitation_probability",),
    fixed.NOTICE: ("other_special_notice",),
    fixed.WARMTH: ("feels_like_temp",),
    fixed.HYDRATION: ("feels_like_temp",),
}


def _group(name: str, reasons: str) -> str:
    return f"named_struct('code', {quote(name)}, 'action', {quote(fixed.GROUP_ACTIONS[name])}, 'reasons', {reasons})"


def any_unknown() -> str:
    return any_of(_in(i, "UNKNOWN") for i in fixed.INDICES)


def missing_names() -> str:
    """Sorted names of the indices graded UNKNOWN."""
    return present(f"if({_in(i, 'UNKNOWN')}, {quote(i)}, null)" for i in sorted(fixed.INDICES))


def missing_count() -> str:
    return " + ".join(f"if({_in(i, 'UNKNOWN')}, 1, 0)" for i in fixed.INDICES)


def action_groups() -> str:
    """Ordered ARRAY<STRUCT<code, action, reasons>>; a fallback group when none is active."""

    def reasons(name: str) -> str:
        texts = (f"concat({quote(fixed.REASON_LABELS[i] + ': ')}, {label_of(i)})" for i in _REASON_INDICES[name])
        return f"array({listed(texts)})"

    flags = action_flags()
    active = present(f"if({flag}, {_group(n, reasons(n))}, null)" for n, flag in flags.items())
    lacking = f"array(concat({quote(fixed.INSUFFICIENT_REASON)}, array_join({missing_names()}, ', ')))"
    normal = f"array({quote(fixed.ALL_NORMAL_REASON)})"
    return (
        f"case when {any_of(flags.values())} then {active}"
        f" when {any_unknown()} then array({_group(fixed.INSUFFICIENT, lacking)})"
        f" else array({_group(fixed.ALL_NORMAL, normal)}) end"
    )


def severity() -> str:
    """CRITICAL / HIGH / MEDIUM / LOW straight from grades, without building the groups."""
    f = action_flags()
    return (
        f"case when {f[fixed.STAY_IN]} then 'CRITICAL' when {f[fixed.MASK]} or {f[fixed.NOTICE]} then 'HIGH'"
        f" when {any_of(f.values())} or {any_unknown()} then 'MEDIUM' else 'LOW' end"
    )


def severity_of_groups(names: str) -> str:
    """Severity of an ARRAY<STRING> of group names, as stored in the history."""

    def has(*groups: str) -> str:
        return any_of(f"array_contains({names}, {quote(g)})" for g in groups)

    return (
        f"case when {has(fixed.STAY_IN)} then 'CRITICAL' when {has(fixed.MASK, fixed.NOTICE)} then 'HIGH'"
        f" when {has(fixed.SUNSCREEN, fixed.WARMTH, fixed.ALLERGY, fixed.UMBRELLA)} then 'MEDIUM'"
        f" when {has(fixed.ALL_NORMAL)} then 'LOW' else 'MEDIUM' end"
    )


def signature(indices: Sequence[str] = fixed.INDICES) -> str:
    """`index=label` joined by `|` in code-point order: changes with grades, not with values."""
    return f"concat_ws('|', {listed(f'concat({quote(i + chr(61))}, {label_of(i)})' for i in sorted(indices))})"


def core_missing() -> str:
    """Both particulate indices are unknown or absent: nothing to base an alert on."""
    return "(coalesce(pm10_grade, 'UNKNOWN') = 'UNKNOWN' and coalesce(pm25_grade, 'UNKNOWN') = 'UNKNOWN')"


# -- user-supplied rule tables --------------------------------------------------------------------

BAND_TABLE_SCHEMA = "index_name string, upper double, grade string, advice string, icon string"
_INLINE_BANDS = 2_000


def band_table(spark) -> DataFrame:
    """The built-in bands as an editable table."""
    rows = (
        f"({quote(i)}, {number(b[0])}, {listed(map(quote, b[1:]))})" for i, bands in fixed.BANDS.items() for b in bands
    )
    return spark.sql(f"select * from values {listed(rows)} as t(index_name, upper, grade, advice, icon)")


def grade_by_table(readings: DataFrame, bands: DataFrame) -> DataFrame:
    """Grade long readings `(.., index_name, value)` by a rule table.

    The table is folded to one ordered band list per index, so the join is an equi-join that yields
    exactly one row per reading; the band itself is found inside the row. The folded table is small
    for any hand-edited rule set and is broadcast only when its size has been checked.
    """
    folded = bands.groupBy("index_name").agg(
        F.sort_array(F.collect_list(F.struct("upper", "grade", "advice", "icon"))).alias("_bands")
    )
    if bands.limit(_INLINE_BANDS + 1).count() <= _INLINE_BANDS:
        folded = F.broadcast(folded)
    hit = f"""case when value is null or _bands is null
        then named_struct('upper', cast(null as double), 'grade', 'UNKNOWN',
                          'advice', {quote(fixed.UNKNOWN_ADVICE)}, 'icon', {quote(fixed.UNKNOWN_ICON)})
        else coalesce(get(filter(_bands, b -> value <= b.upper), 0), element_at(_bands, -1)) end as _hit"""
    return (
        readings.join(folded, "index_name", "left")
        .selectExpr(*readings.columns, hit)
        .select(*readings.columns, "_hit.grade", "_hit.advice", "_hit.icon")
    )
