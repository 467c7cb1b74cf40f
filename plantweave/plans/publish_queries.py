"""The publishing pass and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantweave.operators import drift
from plantweave.plans import views as v
from plantweave.plans.asset_queries import _LIFE, COOLDOWN_MS, STALE_MS
from plantweave.plans.drift_queries import ORDERED_FOREST, sql_cooldown
from plantweave.plans.publish import State, publish_pass, summary
from plantweave.plans.registry import query
from plantweave.plans.semantic_queries import _INLINE, _VALIDATED, CUT_MS
from plantweave.session import shared_folder
from plantweave.sources.sinks import KeyedTable
from plantweave.streaming import processors, sinks

_PASS = f"""{_VALIDATED}, {v.IDENTITIES},
paths AS (SELECT path, replace(substr(path, 8), '.', '/') AS topic_path FROM (SELECT DISTINCT path FROM metrics)),
placed AS (SELECT v.*, p.prefix || '/context/Events/' || topic_path AS topic, p.asset AS device_id
  FROM validated v JOIN prefixes p USING (asset_id) JOIN paths USING (path)),
fps AS (SELECT asset_id, path, timestamp_ms < {CUT_MS} AS before, arg_max(value_type, elem_order) AS value_type,
    arg_max(struct_pack(s := semantic_id, u := unit), elem_order) AS su FROM metrics GROUP BY ALL),
drifted AS (SELECT coalesce(a.asset_id, b.asset_id) AS asset_id FROM (SELECT * FROM fps WHERE before AND asset_id IN (SELECT asset_id FROM fps WHERE NOT before)) a
  FULL JOIN (SELECT * FROM fps WHERE NOT before) b ON a.asset_id = b.asset_id AND a.path = b.path
  WHERE a.path IS NULL OR b.path IS NULL OR a.value_type <> b.value_type OR a.su IS DISTINCT FROM b.su),
stored AS (SELECT topic, arg_max(value_json, elem_order) AS value_json FROM placed WHERE timestamp_ms < {CUT_MS} GROUP BY topic),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY elem_order DESC) AS rn FROM placed WHERE timestamp_ms >= {CUT_MS} AND len(errors) = 0) WHERE rn = 1),
chg AS (SELECT c.* FROM cur c LEFT JOIN stored s USING (topic) WHERE c.value_json IS DISTINCT FROM s.value_json),
born AS (SELECT DISTINCT device_id FROM placed WHERE timestamp_ms < {CUT_MS} AND unit = 'USD')"""


def one_pass(spark, sf):
    """The rows after the cut, on the state that the rows before it left."""
    metrics = v.metrics(spark, sf)
    before = v.topics(spark, sf).filter(F.col("timestamp_ms") < CUT_MS)
    hashes = before.groupBy("topic").agg(
        F.sha2(F.max_by("value_json", F.struct("timestamp_ms", "elem_order")), 256).alias("hash"),
        F.max("timestamp_ms").alias("updated_at"),
        F.min("timestamp_ms").alias("created_at"),
    )
    state = State(
        fingerprints=drift.fingerprints(metrics.filter(F.col("timestamp_ms") < CUT_MS)),
        hashes=hashes,
        births=before.filter("unit = 'USD'").select("device_id").distinct(),
    )
    later = metrics.filter(F.col("timestamp_ms") >= CUT_MS)
    return publish_pass(later, state, v.rules(spark), v.constraints(spark))


@query(
    "publish_pass",
    f"""WITH {_PASS} SELECT 'drift_events' AS output, count(*) AS n FROM drifted
    UNION ALL SELECT 'valid_rows', count(*) FROM validated WHERE timestamp_ms >= {CUT_MS} AND len(errors) = 0
    UNION ALL SELECT 'topics', count(*) FROM cur UNION ALL SELECT 'changed', count(*) FROM chg
    UNION ALL SELECT 'assets', count(DISTINCT asset_id) FROM cur
    UNION ALL SELECT 'births', count(*) FROM cur WHERE device_id NOT IN (SELECT device_id FROM born)
    UNION ALL SELECT 'data', count(*) FROM chg WHERE device_id IN (SELECT device_id FROM born)""",
)
def publish_pass_summary(spark, sf):
    return summary(one_pass(spark, sf))


@query("publish_pass_payloads", f"WITH {_PASS} SELECT topic, {_INLINE} AS payload FROM chg")
def publish_pass_payloads(spark, sf):
    return one_pass(spark, sf).payloads.select("topic", "payload")


# -- streams ------------------------------------------------------------------


def event_stream(spark, sf):
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf)
    )
    return raw.select(
        "event_id", v.epoch_ms(F.col("ts")).alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _run(spark, name, stream):
    return sinks.run_available(stream, shared_folder(spark, name), shared_folder(spark, name + "-checkpoint"))


@query(
    "stream_cooldown",
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ts FROM events),
    {sql_cooldown('e', 'user_id', 'ts', COOLDOWN_MS)} SELECT CAST(k AS VARCHAR) AS k, t AS ts FROM fired""",
)
def stream_cooldown(spark, sf):
    processors.use_rocksdb(spark)
    rows = event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("k"), "ts", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("ord")
    )
    return _run(spark, "cooldown", processors.cooldown_stream(rows, COOLDOWN_MS)).select("k", "ts")


@query(
    "stream_changed_values",
    f"""WITH {v.METRICS}, seen AS (SELECT *, sha256(value_json) AS hash, lag(sha256(value_json)) OVER (PARTITION BY asset_id, path ORDER BY timestamp_ms, elem_order) AS previous FROM metrics)
    SELECT event_id, hash FROM seen WHERE hash IS DISTINCT FROM previous""",
)
def stream_changed_values(spark, sf):
    processors.use_rocksdb(spark)
    rows = v.metrics_of(event_stream(spark, sf)).select(
        F.concat_ws("|", "asset_id", "path").alias("k"), F.col("timestamp_ms").alias("ts"),
        F.col("elem_order").alias("ord"), "value_json",
    )
    out = _run(spark, "changed", processors.changed_stream(rows))
    return out.select(F.col("ord").cast("bigint").alias("event_id"), "hash")


WATERMARK_MS = 3_600_000


@query(
    "stream_lifecycle",
    f"""WITH {_LIFE.replace(str(v.AS_OF_MS), f'(SELECT max(ts) - {WATERMARK_MS} FROM activity)')} SELECT asset_id, previous_state, new_state, timestamp_ms, reason FROM life""",
)
def stream_lifecycle(spark, sf):
    processors.use_rocksdb(spark)
    rows = event_stream(spark, sf).select(
        F.concat(F.lit(v.ASSET), F.col("user_id")).alias("asset_id"), "ts",
        F.when(F.col("event_type") == "error", "death").otherwise("data").alias("kind"), F.col("event_id").alias("seq"),
    )
    return _run(spark, "lifecycle", processors.lifecycle_stream(rows, STALE_MS))


@query(
    "stream_anomaly_scores",
    f"WITH RECURSIVE {ORDERED_FOREST} SELECT asset_id AS k, timestamp_ms AS ts, elem_order AS ord, round(score, 9) AS score FROM scores",
)
def stream_anomaly_scores(spark, sf):
    processors.use_rocksdb(spark)
    metrics = v.metrics_of(event_stream(spark, sf))
    out = _run(spark, "anomaly", processors.anomaly_stream(metrics))
    return out.withColumn("score", F.round("score", 9))


@query(
    "stream_current_values",
    f"WITH {v.METRICS} SELECT asset_id, path, arg_max(value_json, elem_order) AS value_json FROM metrics GROUP BY ALL",
)
def stream_current_values(spark, sf):
    stream = v.metrics_of(event_stream(spark, sf)).select(
        "asset_id", "path", "value_json", "timestamp_ms", "elem_order"
    )
    schema = "asset_id STRING, path STRING, value_json STRING, timestamp_ms BIGINT, elem_order STRING"
    table = KeyedTable.scratch(spark, "current", schema)
    sink = sinks.upsert_each_batch(table, ["asset_id", "path"], ["timestamp_ms", "elem_order"])
    sinks.run_available_batches(stream, sink, shared_folder(spark, "current-checkpoint"))
    return table.read().select("asset_id", "path", "value_json")
