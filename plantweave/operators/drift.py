"""Structural drift: which metrics an asset has, and how they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantweave.functions.json import json_object, or_null, quoted
from plantweave.operators.mapping import alert_topic
from plantweave.operators.ordered import latest_per_key

KEYS = ["asset_id", "submodel", "path"]
SHAPE = ["aas_type", "value_type", "semantic_id", "unit"]
CHANGES = ["type_changed", "unit_changed", "semantic_changed"]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("None"))


def fingerprint_hash() -> Column:
    """Hash of a metric's structure; NULL parts read ``None``."""
    return F.substring(F.sha2(F.concat_ws("|", F.col("path"), *map(_text, SHAPE)), 256), 1, 16)


def fingerprints(metrics: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """One fingerprint per (asset, submodel, path): the last metric's structure."""
    keys = [*(extra_keys or []), *KEYS]
    rows = metrics.select(*keys, *SHAPE, "timestamp_ms", "elem_order")
    last = latest_per_key(rows, keys, ["timestamp_ms", "elem_order"])
    return last.select(*keys, *SHAPE, fingerprint_hash().alias("fingerprint"))


def detect(
    stored: DataFrame,
    current: DataFrame,
    additions: bool = True,
    removals: bool = True,
    changes: bool = True,
    extra_keys: list[str] | None = None,
) -> DataFrame:
    """Drift events between stored and current fingerprints.

    Of several differences of one metric the first of type, unit and semantic id counts.
    """
    keys = [*(extra_keys or []), *KEYS]
    before = stored.select(*keys, F.struct(*SHAPE).alias("previous"))
    after = current.select(*keys, F.struct(*SHAPE).alias("current"))
    both = before.join(after, keys, "full_outer")

    def differs(field: str) -> Column:
        return ~F.col(f"previous.{field}").eqNullSafe(F.col(f"current.{field}"))

    event = (
        F.when(F.col("previous").isNull(), "added")
        .when(F.col("current").isNull(), "removed")
        .when(differs("value_type"), "type_changed")
        .when(differs("unit"), "unit_changed")
        .when(differs("semantic_id"), "semantic_changed")
    )
    wanted = ["added"] * additions + ["removed"] * removals + CHANGES * changes
    return (
        both.withColumn("event_type", event)
        .filter(F.col("event_type").isin(wanted))
        .select(*keys, "event_type", "previous", "current")
    )


def detect_in_snapshots(snapshots: DataFrame, snapshot_ts: str) -> DataFrame:
    """Drift between each snapshot of an asset's submodel and the one before.

    Each snapshot's rows also travel to the next snapshot of the submodel as its
    stored side, so a run over many snapshots is one full outer join.
    """
    keys = ["asset_id", "submodel"]
    # One row per (asset, submodel, snapshot): the window holds times, not metrics.
    times = snapshots.select(*keys, snapshot_ts).distinct()
    over = Window.partitionBy(*keys).orderBy(snapshot_ts)
    nexts = times.withColumn("_next", F.lead(snapshot_ts).over(over)).filter("_next IS NOT NULL")
    stored = (
        snapshots.join(nexts, [*keys, snapshot_ts])
        .drop(snapshot_ts)
        .withColumnRenamed("_next", snapshot_ts)
    )
    first = times.groupBy(*keys).agg(F.min(snapshot_ts).alias("_first"))
    later = snapshots.join(first, keys).filter(F.col(snapshot_ts) > F.col("_first")).drop("_first")
    return detect(stored, later, extra_keys=[snapshot_ts])


def replace_fingerprints(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored fingerprints with every (asset, submodel) of ``current`` replaced."""
    touched = current.select("asset_id", "submodel").distinct()
    kept = stored.join(touched, ["asset_id", "submodel"], "left_anti")
    return kept.unionByName(current.select(*stored.columns))


def summary(events: DataFrame) -> DataFrame:
    """Additions, removals and changes per asset."""
    kind = F.col("event_type")
    return events.groupBy("asset_id").agg(
        F.count_if(kind == "added").alias("additions"),
        F.count_if(kind == "removed").alias("removals"),
        F.count_if(kind.isin(CHANGES)).alias("changes"),
        (F.count(F.lit(1)) > 0).alias("has_drift"),
    )


def alerts(events: DataFrame, timestamp_ms: Column, prefix: str = "UNS/Sys/DriftAlerts") -> DataFrame:
    """(topic, payload) per drift event."""

    def shape(side: str) -> Column:
        body = json_object(
            ("aasType", or_null(quoted(F.col(f"{side}.aas_type")))),
            ("valueType", or_null(quoted(F.col(f"{side}.value_type")))),
            ("semanticId", or_null(quoted(F.col(f"{side}.semantic_id")))),
            ("unit", or_null(quoted(F.col(f"{side}.unit")))),
        )
        return F.when(F.col(side).isNotNull(), body)

    payload = json_object(
        ("eventType", quoted(F.col("event_type"))),
        ("assetId", quoted(F.col("asset_id"))),
        ("metricPath", quoted(F.col("path"))),
        ("timestamp", timestamp_ms),
        ("previous", shape("previous")),
        ("current", shape("current")),
    )
    return events.select(
        alert_topic(prefix, F.col("asset_id")).alias("topic"), payload.alias("payload")
    )


def schema_hashes(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of the whole metric set per group of fingerprints.

    The list holds one entry per metric of one submodel snapshot, that is at most
    what came out of one document, however many rows were observed.
    """
    part = F.concat_ws("|", F.col("path"), *[_text(c) for c in SHAPE[:3]])
    return snapshots.groupBy(*keys).agg(
        F.substring(
            F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256), 1, 16
        ).alias("schema_hash"),
        F.count(F.lit(1)).alias("metric_count"),
    )


def schema_evolution(hashes: DataFrame, snapshot_ts: str) -> DataFrame:
    """Schema drift results: a submodel's hash differs from its previous snapshot's."""
    over = Window.partitionBy("asset_id", "submodel").orderBy(snapshot_ts)
    before = F.lag("schema_hash").over(over)
    return (
        hashes.withColumn("previous_hash", before)
        .filter("previous_hash IS NOT NULL AND previous_hash <> schema_hash")
        .select(
            "asset_id",
            "submodel",
            snapshot_ts,
            F.lit(True).alias("is_drift"),
            F.lit("schema_evolution").alias("drift_type"),
            F.lit("medium").alias("severity"),
            F.lit(0.95).alias("confidence"),
            F.lit(1.0).alias("anomaly_score"),
            F.lit("alert").alias("suggested_action"),
            "previous_hash",
            F.col("schema_hash").alias("current_hash"),
            "metric_count",
        )
    )


def check_and_store(stored: DataFrame, metrics: DataFrame, timestamp_ms: Column):
    """(event counts by type, alert rows, fingerprints to store) for one pass.

    Runs on the rows before validation, so that rejected rows do not look removed.
    """
    current = fingerprints(metrics)
    touched = current.select("asset_id", "submodel").distinct()
    known = stored.join(touched, ["asset_id", "submodel"], "left_semi")
    events = detect(known, current)
    by_type = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return by_type, alerts(events, timestamp_ms), replace_fingerprints(stored, current)


def tracked_assets(stored: DataFrame) -> DataFrame:
    return stored.select("asset_id").distinct()


def clear_asset(stored: DataFrame, asset_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, number of rows cleared)."""
    gone = stored.join(asset_ids, "asset_id", "left_semi")
    kept = stored.join(asset_ids, "asset_id", "left_anti")
    return kept, gone.agg(F.count(F.lit(1)).alias("cleared"))
