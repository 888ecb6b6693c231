"""Writing Spark SQL expressions as text.

Long rule expressions (bands, groups, texts) are composed as SQL and handed to Spark in one piece:
building them from Column calls costs a JVM round trip per operator, seconds for a wide message. Functions
that say "SQL" take and return SQL fragments; a fragment may be a plain column name.
"""

from __future__ import annotations

from collections.abc import Iterable


def quote(text: str | None) -> str:
    """SQL string literal."""
    if text is None:
        return "null"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def number(value: float) -> str:
    """SQL double literal."""
    return f"{float(value)!r}D"


def listed(fragments: Iterable[str]) -> str:
    return ", ".join(fragments)


def present(fragments: Iterable[str]) -> str:
    """Array of the fragments that are not null, in order."""
    return f"array_compact(array({listed(fragments)}))"


def any_of(fragments: Iterable[str]) -> str:
    return "(" + " or ".join(f"({f})" for f in fragments) + ")"
