"""Alert texts as columns over all alerts at once.

Input rows are graded messages with advice columns (`with_grades(.., advice=True)`), the
`action_groups` array, `region`, `timestamp` (ISO text), `forecast_type`, `min_temperature`,
`max_temperature` and the `data_warnings` map. `prepare` adds the display value and label of each index
once; the text builders return SQL over the prepared rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from skygauge import fixed
from skygauge.functions.grading import label_of
from skygauge.functions.scalars import display_value, float_text
from skygauge.functions.text import listed, present, quote

_NOTICE = "other_special_notice"
_TEMPERATURES = ("min_temperature", "max_temperature")


def prepare(alerts: DataFrame) -> DataFrame:
    """Add `<index>_shown` and `<index>_label`, and shown temperatures where the columns exist."""
    shown = [f"{display_value(i, unit, i == _NOTICE)} as {i}_shown" for i, _, unit in fixed.DISPLAY_ROWS]
    labels = [f"{label_of(i)} as {i}_label" for i in fixed.INDICES]
    degrees = [f"{display_value(t, '℃')} as {t}_shown" for t in _TEMPERATURES if t in alerts.columns]
    return alerts.selectExpr("*", *shown, *labels, *degrees)


def display_array() -> str:
    """Nine ordered rows: index, label, value with unit, grade, advice."""
    return f"""array({listed(
        f"struct({quote(i)} as index_name, {quote(name)} as label, {i}_shown as value, {i}_label as grade, {i}_advice as advice)"
        for i, name, _ in fixed.DISPLAY_ROWS
    )})"""


def display_rows(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """Nine rows per alert: position, index, label, value with unit, grade, advice."""
    return prepared.selectExpr(*keys, f"posexplode({display_array()}) as (position, _r)").select(*keys, "position", "_r.*")


def title() -> str:
    whens = " ".join(f"when {quote(k)} then {quote(t)}" for k, t in fixed.TITLES.items())
    return f"case forecast_type {whens} else {quote(fixed.TITLE_DEFAULT)} end"


def top_risks() -> str:
    """First three rows graded bad or worse, else the first three normal ones, in display order."""

    def lines(*codes: str) -> str:
        wanted = listed(map(quote, codes))
        hits = (
            f"if({i}_grade in ({wanted}), concat({quote(f'- {n} ')}, {i}_shown, ': ', {i}_label), null)"
            for i, n, _ in fixed.DISPLAY_ROWS
        )
        return f"slice({present(hits)}, 1, 3)"

    def some(*codes: str) -> str:
        return " or ".join(f"coalesce({i}_grade in ({listed(map(quote, codes))}), false)" for i in fixed.INDICES)

    return (
        f"case when {some('BAD', 'VERY_BAD')} then {lines('BAD', 'VERY_BAD')}"
        f" when {some('NORMAL')} then {lines('NORMAL')} else array({quote(fixed.TEXT_MOSTLY_GOOD)}) end"
    )


def _has_group(code: str) -> str:
    return f"array_contains(action_groups.code, {quote(code)})"


_IS_NORMAL = _has_group(fixed.ALL_NORMAL)


def _temperatures(words: tuple[str, str]) -> str:
    return (
        "case when min_temperature is not null or max_temperature is not null then"
        f" concat({quote(words[0])}, min_temperature_shown, {quote(words[1])}, max_temperature_shown) end"
    )


def short_text() -> str:
    """Compact text: title with time, two actions, top risks and a summary, at most 1000 characters."""
    time = f"if(length(timestamp) >= 16, substring(timestamp, 12, 5), {quote(fixed.TEXT_TIME_UNKNOWN)})"
    actions = (
        f"if({_IS_NORMAL}, array({quote('- ' + fixed.TEXT_NO_ACTION)}),"
        " transform(slice(action_groups, 1, 2), g -> concat('- ', g.action)))"
    )
    lines = [
        f"concat('[', region, ' ', {title()}, '] ', {time})",
        "''",
        quote(fixed.TEXT_ACTIONS),
        actions,
        "''",
        quote(fixed.TEXT_RISKS),
        top_risks(),
        "''",
        quote(fixed.TEXT_REST),
        _temperatures(fixed.SHORT_TEMPERATURES),
        "concat('미세먼지 ', pm10_label, ', 초미세먼지 ', pm25_label)",
        "concat('황사 ', dust_label, ', 강수확률 ', precipitation_probability_shown, ', 자외선 ', uv_index_shown)",
        f"concat('특보 ', {_NOTICE}_shown)",
    ]
    return f"substring(concat_ws('\\n', {listed(lines)}), 1, {fixed.SHORT_TEXT_LIMIT})"


def alert_color() -> str:
    return (
        f"case when {_has_group(fixed.STAY_IN)} then {quote(fixed.COLOR_DANGER)}"
        f" when {_has_group(fixed.MASK)} then {quote(fixed.COLOR_CAUTION)} else {quote(fixed.COLOR_CALM)} end"
    )


def webhook_fields() -> str:
    """Fields of the indices that have a value."""
    return present(
        f"if({i} is not null, named_struct('title', {quote(name)}, 'value',"
        f" concat({i if i == _NOTICE else float_text(i)}, ' (', {i}_label, ')'), 'short', true), null)"
        for i, name in fixed.WEBHOOK_FIELDS
    )


def action_text() -> str:
    lines = "array_join(transform(action_groups, g -> concat('• ', g.code, ': ', g.action)), '\\n')"
    return f"if({_IS_NORMAL}, {quote(fixed.WEBHOOK_ALL_NORMAL)}, {lines})"


def webhook_payload() -> str:
    """JSON for a chat webhook: colour, fields and actions.

    The two attachments differ in shape, so the list is joined from their JSON texts.
    """
    head = (
        f"named_struct('fallback', concat(region, {quote(fixed.WEBHOOK_TITLE)}), 'color', {alert_color()},"
        f" 'title', concat('🌍 ', region, {quote(fixed.WEBHOOK_TITLE)}), 'text', timestamp, 'fields', {webhook_fields()},"
        f" 'footer', {quote(fixed.WEBHOOK_FOOTER)}, 'ts', unix_seconds(try_to_timestamp(timestamp)))"
    )
    tail = (
        f"named_struct('color', {alert_color()}, 'title', {quote(fixed.WEBHOOK_ACTIONS)}, 'text', {action_text()},"
        " 'mrkdwn_in', array('text'))"
    )
    opening = f'{{"username":"{fixed.WEBHOOK_NAME}","icon_emoji":"{fixed.WEBHOOK_ICON}","attachments":['
    return f"concat({quote(opening)}, to_json({head}), ',', to_json({tail}), ']}}')"


def subject() -> str:
    return f"concat('[', {title()}, '] ', region, {quote(fixed.SUBJECT_SUFFIX)})"


_NOTES = "coalesce(map_entries(data_warnings), cast(array() as array<struct<key:string,value:string>>))"


def long_text() -> str:
    """Plain mail body."""
    actions = (
        f"if({_IS_NORMAL}, array({quote('- ' + fixed.LONG_ALL_NORMAL)}), transform(action_groups,"
        " g -> concat('- ', g.code, ': ', g.action, ' (', array_join(g.reasons, ', '), ')')))"
    )
    details = f"transform({display_array()}, r -> concat('- ', r.label, ': ', r.value, ' / ', r.grade, ' / ', r.advice))"
    temperatures = _temperatures(fixed.LONG_TEMPERATURES)
    notes = f"transform({_NOTES}, e -> concat('- ', e.key, ': ', e.value))"
    lines = [
        f"concat(region, ' ', {title()})",
        f"concat({quote(fixed.LONG_COLLECTED_AT)}, timestamp)",
        "''",
        quote(fixed.LONG_ACTIONS),
        actions,
        "''",
        f"if({temperatures} is null, null, array({temperatures}, ''))",
        quote(fixed.LONG_DETAILS),
        details,
        f"if(size(data_warnings) > 0, concat(array('', {quote(fixed.LONG_NOTES)}), {notes}), null)",
    ]
    return f"concat_ws('\\n', {listed(lines)})"


def _escape(text: str) -> str:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda t, p: f"replace({t}, {quote(p[0])}, {quote(p[1])})", pairs, text)


def long_html() -> str:
    """HTML mail body; every inserted value is escaped."""

    def tag(name: str, *parts: str) -> str:
        return f"concat('<{name}>', {listed(parts)}, '</{name}>')"

    cells = [tag("td", _escape(f"r.{c}")) for c in ("value", "grade", "advice")]
    rows = f"array_join(transform({display_array()}, r -> {tag('tr', tag('th', 'r.label'), *cells)}), '\\n')"
    reasons = _escape("array_join(g.reasons, ', ')")
    item = tag("li", tag("strong", _escape("g.code")), "': '", _escape("g.action"), "'<br>'", tag("small", reasons))
    actions = (
        f"if({_IS_NORMAL}, {quote(f'<li>{fixed.LONG_ALL_NORMAL}</li>')},"
        f" array_join(transform(action_groups, g -> {item}), ''))"
    )
    note = tag("li", tag("strong", _escape("e.key")), "': '", _escape("e.value"))
    notes = f"array_join(transform({_NOTES}, e -> {note}), '')"
    header = "".join(f"<th>{h}</th>" for h in fixed.LONG_HEADERS)
    lines = [
        "'<html><body>'",
        tag("h2", _escape("region"), "' '", title()),
        tag("p", quote(fixed.LONG_COLLECTED_AT), _escape("timestamp")),
        quote(f"<h3>{fixed.LONG_ACTIONS}</h3>"),
        tag("ul", actions),
        tag("p", tag("strong", _temperatures(fixed.LONG_TEMPERATURES))),
        quote(f'<h3>{fixed.LONG_DETAILS}</h3><table border="1"><tr>{header}</tr>'),
        rows,
        "'</table>'",
        f"if(size(data_warnings) > 0, concat({quote(f'<h3>{fixed.LONG_NOTES}</h3>')}, {tag('ul', notes)}), null)",
        "'</body></html>'",
    ]
    return f"concat_ws('\\n', {listed(lines)})"
