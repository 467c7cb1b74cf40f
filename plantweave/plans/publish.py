"""One publishing pass: every operator in its order over one set of metric rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.functions import semantics
from plantweave.operators import dedup, drift, fidelity, mapping, messages, validation
from plantweave.operators.ordered import latest_per_key
from plantweave.session import ensure_checkpoint_dir
from plantweave.sources.rules import MappingRules


@dataclass
class State:
    """Tables a pass starts from."""

    fingerprints: DataFrame
    hashes: DataFrame
    births: DataFrame


@dataclass
class Pass:
    """Tables a pass produces."""

    drift_events: DataFrame
    validated: DataFrame
    topics: DataFrame
    changed: DataFrame
    payloads: DataFrame
    assets: DataFrame
    fidelity: DataFrame
    device_rows: DataFrame
    next_fingerprints: DataFrame
    next_hashes: DataFrame


def publish_pass(
    metrics: DataFrame,
    state: State,
    rules: MappingRules,
    constraints: DataFrame,
    reject_invalid: bool = True,
    mode: str = "inline",
    source_name: str = "plantweave",
) -> Pass:
    """Drift on all rows, then validation, topics, changed values, payloads, device rows.

    The validated rows and the topics feed several outputs, so each is computed once
    and kept as a checkpoint, which survives a lost executor.
    """
    ensure_checkpoint_dir(metrics.sparkSession)
    current = drift.fingerprints(metrics.filter("asset_id IS NOT NULL"))
    touched = current.select("asset_id", "submodel").distinct()
    known = state.fingerprints.join(touched, ["asset_id", "submodel"], "left_semi")
    events = drift.detect(known, current)
    validated = validation.validate(metrics, constraints).checkpoint()
    kept = validated.filter(F.size("errors") == 0) if reject_invalid else validated
    topics = mapping.last_metric_per_topic(mapping.with_topics(kept.drop("errors"), rules))
    topics = dedup.with_changed(topics, state.hashes).checkpoint()
    # Of the rows that share a topic the last one is published, and its hash is the one to store.
    last = latest_per_key(topics, ["topic"], ["timestamp_ms", "elem_order", "asset_id", "submodel", "path"])
    changed = last.filter("changed")
    payload = semantics.payload(mode, None, source_name)
    device_rows = messages.route(last.filter("asset_id IS NOT NULL"), state.births)
    return Pass(
        drift_events=events,
        validated=validated,
        topics=last,
        changed=changed,
        payloads=changed.select("topic", payload.alias("payload"), "timestamp_ms", "elem_order"),
        assets=topics.filter("asset_id IS NOT NULL").select("asset_id").distinct(),
        fidelity=fidelity.report(topics.filter("asset_id IS NOT NULL")),
        device_rows=device_rows,
        next_fingerprints=drift.replace_fingerprints(state.fingerprints, current),
        next_hashes=dedup.merge_hashes(state.hashes, changed, F.col("timestamp_ms"), ("elem_order",)),
    )


def summary(result: Pass) -> DataFrame:
    """(output, n): row counts of a pass."""
    parts = {
        "drift_events": result.drift_events,
        "valid_rows": result.validated.filter(F.size("errors") == 0),
        "topics": result.topics,
        "changed": result.changed,
        "assets": result.assets,
        "births": result.device_rows.filter("kind = 'DBIRTH'"),
        "data": result.device_rows.filter("kind = 'DDATA'"),
    }
    out = None
    for name, rows in parts.items():
        counted = rows.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out
