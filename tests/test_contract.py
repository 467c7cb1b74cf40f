"""Registered queries against their SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from plantweave.plans import catalogue

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "current_payloads", "topics", "changed_values", "structural_drift", "lifecycle_events", "message_audit",
    "command_audit", "alert_rules", "documents_flattened", "fidelity_report", "validation_errors", "aliases",
    "anomaly_scores_in_order", "stream_anomaly_scores",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["current_payloads", "lifecycle_events", "message_sessions", "structural_drift"])
def test_no_single_partition_window_and_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Exchange SinglePartition" not in plan


def test_columns_are_pruned_at_the_scan(spark):
    plan = entry.queries()["lifecycle_events"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
