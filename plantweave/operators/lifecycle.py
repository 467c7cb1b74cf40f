"""Online, stale and offline states of assets from data and death rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantweave.functions.json import json_object, or_null, quoted
from plantweave.operators.mapping import alert_topic
from plantweave.operators.ordered import running_before

STALE_AFTER_MS = 300_000


def _event(previous: Column, new: str, ts: Column, reason: Column) -> Column:
    return F.struct(
        previous.cast("string").alias("previous_state"),
        F.lit(new).alias("new_state"),
        ts.alias("timestamp_ms"),
        reason.alias("reason"),
    )


def _last_times() -> list[Column]:
    data, death = F.col("kind") == "data", F.col("kind") == "death"
    return [
        F.max(F.when(data, F.col("ts"))).alias("last_data"),
        F.max(F.when(death, F.col("ts"))).alias("last_death"),
    ]


def events(activity: DataFrame, as_of_ms: int | Column, stale_ms: int = STALE_AFTER_MS) -> DataFrame:
    """State changes of every asset up to ``as_of_ms``.

    ``activity`` has ``asset_id``, ``ts`` (epoch ms), ``kind`` (data or death) and a
    unique ``seq``. A death at the instant of a data row counts after it.
    """
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    is_data = F.col("kind") == "data"
    rows = activity.select("asset_id", "ts", "kind", "seq").withColumn(
        "_rank", F.when(is_data, 0).otherwise(1)
    )
    seen = running_before(
        rows,
        ["asset_id"],
        ["ts", "_rank", "seq"],
        "ts",
        {
            "d": ("max", F.when(is_data, F.col("ts"))),
            "x": ("max", F.when(~is_data, F.col("ts"))),
        },
    )
    ts, d, x = F.col("ts"), F.col("d"), F.col("x")
    reason = F.lit(f"no_data_for_{stale_ms // 1000}s")
    off = d.isNotNull() & x.isNotNull() & (x >= d)
    gap = d.isNotNull() & ~off & (ts - d > stale_ms)
    stale = F.when(gap, _event(F.lit("online"), "stale", d + stale_ms, reason))
    state = F.when(gap, "stale").otherwise("online")
    on_data = (
        F.when(d.isNull(), _event(F.lit(None), "online", ts, F.lit("first_seen")))
        .when(off, _event(F.lit("offline"), "online", ts, F.lit("data_received")))
        .when(gap, _event(F.lit("stale"), "online", ts, F.lit("data_received")))
    )
    on_death = F.when(d.isNotNull() & ~off, _event(state, "offline", ts, F.lit("ddeath")))
    inner = seen.select(
        "asset_id",
        F.inline(F.array_compact(F.array(stale, F.when(is_data, on_data).otherwise(on_death)))),
    )
    last = rows.groupBy("asset_id").agg(*_last_times())
    d, x = F.col("last_data"), F.col("last_death")
    tail = last.filter((x.isNull() | (x < d)) & (as_of - d > stale_ms)).select(
        "asset_id", F.inline(F.array(_event(F.lit("online"), "stale", d + stale_ms, reason)))
    )
    return inner.unionByName(tail)


def status(activity: DataFrame, as_of_ms: int | Column, stale_ms: int = STALE_AFTER_MS) -> DataFrame:
    """Current state, first and last sighting and age of every asset that sent data."""
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    is_data = F.col("kind") == "data"
    agg = activity.groupBy("asset_id").agg(
        F.min(F.when(is_data, F.col("ts"))).alias("first_seen_ms"), *_last_times()
    )
    # Deaths before the first data row concern an unknown asset and change nothing.
    d, x = F.col("last_data"), F.col("last_death")
    state = F.when(x >= d, "offline").when(as_of - d > stale_ms, "stale").otherwise("online")
    return agg.filter(d.isNotNull()).select(
        "asset_id",
        state.alias("state"),
        "first_seen_ms",
        d.alias("last_seen_ms"),
        ((as_of - d) / 1000).alias("age_s"),
    )


def asset_topics(rows: DataFrame) -> DataFrame:
    """The topics of each asset, one row each, so no asset's set sits in one value."""
    return rows.select("asset_id", "topic").distinct()


def status_with_topics(states: DataFrame, topics: DataFrame) -> DataFrame:
    counts = topics.groupBy("asset_id").agg(F.count(F.lit(1)).alias("topic_count"))
    return states.join(counts, "asset_id", "left").fillna(0, ["topic_count"])


def state_counts(states: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg(count("online"), count("stale"), count("offline"), F.count(F.lit(1)).alias("total"))


def event_payloads(state_events: DataFrame, prefix: str = "UNS/Sys/Lifecycle") -> DataFrame:
    """(topic, payload) per state change; NULLs stay in the payload."""
    payload = json_object(
        ("assetId", quoted(F.col("asset_id"))),
        ("previousState", or_null(quoted(F.col("previous_state")))),
        ("newState", quoted(F.col("new_state"))),
        ("timestamp", F.col("timestamp_ms")),
        ("reason", quoted(F.col("reason"))),
    )
    return state_events.select(
        alert_topic(prefix, F.col("asset_id")).alias("topic"), payload.alias("payload")
    )


def clear_offline_topics(states: DataFrame, topics: DataFrame) -> DataFrame:
    """Tombstones for every topic of an offline asset."""
    gone = states.filter(F.col("state") == "offline").select("asset_id")
    return topics.join(gone, "asset_id", "left_semi").select(
        "topic", F.lit(None).cast("string").alias("payload")
    )


def remove_assets(states: DataFrame, asset_ids: DataFrame) -> DataFrame:
    return states.join(asset_ids, "asset_id", "left_anti")


def gauges(states: DataFrame, ts: Column) -> DataFrame:
    """State counts as sample rows."""
    pairs = [F.struct(F.lit(f"assets_{s}").alias("name"), F.col(s).cast("double").alias("value"))
             for s in ("online", "stale", "offline")]
    return state_counts(states).select(ts.alias("ts"), F.inline(F.array(*pairs)))
