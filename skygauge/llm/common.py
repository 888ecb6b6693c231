"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: The same characters, as a list.
BLANKS = " \t\n\v\f\r"

#: Most rows of a side that is broadcast. Beyond it the plain join is used, which Spark shuffles.
BROADCAST_ROWS = 100_000


def words(text: str = "text") -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def n_words(text: str = "text") -> Column:
    return F.size(words(text)).cast("long")


def n_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hash60(*columns: str) -> Column:
    """60 bits of the MD5 of the columns, which other engines can compute too; nulls differ from empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` with a broadcast hint if it has at most `rows` rows, which is counted; else as it is."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so that no name of theirs meets a name that an operator uses."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def field(name: str) -> str:
    return f"row.`{name}`"
