"""Small helpers of these tests."""

import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")

#: Nulls, empty and very long texts, ties, repeated rows, texts without a word.
AWKWARD = [
    (1, "alpha beta gamma", "a"),
    (1, "alpha beta gamma", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \n\t ", "b"),
    (None, "alpha beta gamma", "b"),
    (None, None, None),
    (5, "word " * 30_000, "c"),
    (6, "x" * 200_000, "c"),
]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def documents(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def clashing(df, *names):
    """`df` with further columns of these names, and one that holds a dot."""
    extra = {n: F.lit("mine") for n in (*names, "row", "h", "t", "_id", "a.b") if n not in df.columns}
    return df.withColumns(extra)


def given(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]
