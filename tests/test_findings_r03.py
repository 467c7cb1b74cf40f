"""Repeated urls and unseen objects without content; grades at their bounds."""

import duckdb
import __spark_entry__ as entry

from plantweave.plans import drift_queries
from plantweave.sources import documents


def test_several_pages_with_one_url(spark, tmp_path):
    pages = [(i, f"u{i % 3}" if i % 5 else None, None if i % 7 == 0 else f"<p>{i % 2}") for i in range(60)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = entry.queries()["changed_objects"](spark, str(tmp_path)).collect()
    want = con.execute(entry.oracle_sql()["changed_objects"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_row_per_object_whatever_the_previous_snapshot_repeats(spark):
    schema = "url string, version_tag string, content string"
    before = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", None, None), ("b", None, "z")], schema)
    now = spark.createDataFrame([("a", "2", "new"), ("a", "3", "x"), ("a", "3", "w"), ("b", None, None), ("c", None, None)], schema)
    got = sorted(tuple(r) for r in documents.changed_objects(now, before).collect())
    assert got == [("a", False), ("a", False), ("a", True), ("b", False), ("c", True)]


def test_grade_at_its_bound_is_that_of_the_sql(spark, tmp_path):
    """60 of 75 values with a meaning: the score is 0.9 but for the rounding of the mean of 0.9s."""
    kinds = ["click"] * 60 + ["error"] * 15
    rows = [(i, 1_704_067_200 + i, 3, kind, 1.0, '{"k": 1}') for i, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["fidelity_report"]).fetchdf()["grade"].tolist()
    assert [r.grade for r in drift_queries.fidelity_report(spark, str(tmp_path)).collect()] == want == ["B+"]


def test_alerts_score_the_rows_once(spark):
    """The cooldown reads stored results; what it returns holds no step of the scoring."""
    from plantweave.operators import anomaly

    def scoring(batches):
        yield from batches

    results = spark.createDataFrame(
        [("a", 0, "value_anomaly", "high", 0.5, 0.8, "alert", "p"), ("a", 5, "value_anomaly", "critical", 0.5, 0.95, "alert", "p"),
         ("a", 20, "value_anomaly", "high", 0.5, 0.8, "alert", "p"), ("a", 40, "value_anomaly", "low", 0.5, 0.4, "alert", "p")],
        "asset_id string, timestamp_ms bigint, drift_type string, severity string, confidence double, anomaly_score double, suggested_action string, path string",
    ).mapInPandas(scoring, "asset_id string, timestamp_ms bigint, drift_type string, severity string, confidence double, anomaly_score double, suggested_action string, path string")
    alerts = anomaly.severe_alerts(results, cooldown_ms=10)
    assert "scoring(" not in alerts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.timestamp_ms for r in alerts.collect()) == [0, 20]
