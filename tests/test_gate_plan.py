"""The gate makes its input once, and heavy rows are dealt to bounded tasks before they are made."""

from skygauge.operators import gate
from skygauge.plans import catalog, views
from tests.conftest import SF_SMALL


def test_input_is_made_once(spark, monkeypatch):
    seen, classify = [], gate._classify

    def watched(rows, silence):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return classify(rows, silence)

    monkeypatch.setattr(gate, "_classify", watched)
    catalog.QUERIES["alert_chain"](spark, SF_SMALL)
    assert len(seen) == 1 and "LogicalRDD" in seen[0]
    # rows and chunk summaries both start from here: neither may hold the parser
    assert "from_json" not in seen[0] and "Relation" not in seen[0]


def test_records_are_made_in_bounded_tasks(spark, monkeypatch):
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    for rows in (views.event_records(spark, SF_SMALL), views.replies(spark, SF_SMALL)):
        assert rows.rdd.getNumPartitions() == max(4, -(-n // 100))
