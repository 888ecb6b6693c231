"""The collect chain reads and parses each reply once, in methods the JVM compiles."""

import re

from pyspark.sql import functions as F

from skygauge.operators import collect, ingest, merge
from skygauge.plans import views
from tests.conftest import SF_SMALL

REPLY = "source string, region string, slot timestamp, status_code int, payload string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_read_and_parsed_once(spark, tmp_path):
    path = str(tmp_path / "replies")
    views.replies(spark, SF_SMALL).write.parquet(path)
    text = plan(collect.collect(spark.read.schema(REPLY).parquet(path)))
    assert len(re.findall(r"Relation \[source", text)) == 1
    assert len(re.findall(r"(?i)parse_?json\(", text)) == 1 and text.count("from_xml(") <= 1
    assert text.count("Aggregate [") == 1 and "Union" not in text


def test_replies_that_lie_together_are_merged_without_a_shuffle(spark):
    replies = views.replies(spark, SF_SMALL)
    stacked = merge.slot_dispatch(collect.stack_readings(collect.readings(replies)))
    physical = stacked._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_generated_methods_stay_below_the_limit_of_the_compiler(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chain = merge.slot_dispatch(collect.stack_readings(collect.readings(views.replies(spark, SF_SMALL))))
        text = spark._jvm.PythonSQLUtils.explainString(chain._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_text_that_cannot_be_json_is_unreadable_and_any_json_is_parsed(spark):
    texts = ["busy", "", " <a/>", "garbage", None, ' {"a":1}', "\n[1]", '"x"', "-1.5", "true", "null", "\t7", "{bad"]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    both = df.select("payload", ingest.parsed(df.payload).isNotNull().alias("got"), F.try_parse_json(df.payload).isNotNull().alias("want")).collect()
    assert [r.got for r in both] == [r.want for r in both]


def test_mean_of_items_equals_the_mean_of_rows(spark):
    given = {1: ["30", "33", "-"], 2: ["inf", "nan", "1e14"], 3: ["0.05", "0.15", "0.1", "1_0.5"], 4: ["", None], 5: ["-0.25"]}
    rows = [(i, v) for i, values in given.items() for v in values]
    want = ingest.station_mean(spark.createDataFrame(rows, "id int, pm10 string"), ["id"], ("pm10",)).collect()
    lists = spark.createDataFrame(
        [(i, [{"v": v} for v in values]) for i, values in given.items()], "id int, items array<map<string,string>>"
    )
    got = lists.selectExpr("id", f"{ingest.mean_of_items('items', 'v')} as pm10").collect()
    assert {r.id: r.pm10 for r in got} == {r.id: r.pm10 for r in want}
