"""Change detection on topic values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantweave.operators.ordered import first_rows, lag_in_order
from plantweave.operators.throttle import cooldown_times

DAY_MS = 86_400_000


def value_hash(value_json: Column) -> Column:
    """Hash of the value literal alone: ``1`` and ``1.0`` differ, metadata is ignored."""
    return F.sha2(value_json, 256)


def changed_in_series(
    rows: DataFrame, key: str = "topic", ts: str = "timestamp_ms", order: str = "elem_order"
) -> DataFrame:
    """Rows of a time series whose value hash differs from the row before."""
    hashed = rows.withColumn("hash", value_hash(F.col("value_json")))
    seen = lag_in_order(hashed, [key], [ts, order], ts, {"previous_hash": "hash"})
    return seen.filter(~F.col("hash").eqNullSafe(F.col("previous_hash"))).drop("previous_hash")


def changed_in_series_with_ttl(
    rows: DataFrame,
    ttl_ms: int = DAY_MS,
    key: str = "topic",
    ts: str = "timestamp_ms",
    order: str = "elem_order",
) -> DataFrame:
    """As :func:`changed_in_series`, and an entry is forgotten ``ttl_ms`` after its creation.

    Updates keep the creation time, so entries are created anew on the greedy
    schedule of :func:`cooldown_times`, whatever the values are.
    """
    hashed = rows.withColumn("hash", value_hash(F.col("value_json")))
    seen = lag_in_order(hashed, [key], [ts, order], ts, {"previous_hash": "hash"})
    created = cooldown_times(rows, [key], ts, ttl_ms).withColumn("_created", F.lit(True))
    first_at = rows.groupBy(key, ts).agg(F.min(order).alias("_first"))
    created = created.join(first_at, [key, ts]).select(key, ts, F.col("_first").alias(order), "_created")
    joined = seen.join(created, [key, ts, order], "left")
    changed = ~F.col("hash").eqNullSafe(F.col("previous_hash"))
    return joined.filter(changed | F.col("_created").isNotNull()).select(
        *hashed.columns, F.coalesce("_created", F.lit(False)).alias("created")
    )


def with_changed(current: DataFrame, published: DataFrame) -> DataFrame:
    """Add ``hash`` and ``changed``: the stored hash differs or there is none."""
    hashed = current.withColumn("hash", value_hash(F.col("value_json")))
    stored = published.select("topic", F.col("hash").alias("_stored"))
    flag = ~F.col("hash").eqNullSafe(F.col("_stored"))
    return hashed.join(stored, "topic", "left").withColumn("changed", flag).drop("_stored")


def changed_since(
    current: DataFrame, published: DataFrame, as_of_ms: int | None = None, ttl_ms: int = DAY_MS
) -> DataFrame:
    """Rows of a snapshot whose hash differs from the stored one or was never stored."""
    stored = published if as_of_ms is None else not_expired(published, as_of_ms, ttl_ms)
    return with_changed(current, stored).filter("changed").drop("changed")


def merge_hashes(
    published: DataFrame, changed: DataFrame, now_ms: Column, order: tuple[str, ...] = ()
) -> DataFrame:
    """Upsert changed hashes; ``updated_at`` moves, ``created_at`` stays.

    A topic that several rows share gets one entry, of the latest of them, so the table
    keeps one row per topic from batch to batch. ``order`` names the columns that say which of
    two rows at one instant is the later; they must be those that choose the retained payload.
    """
    place = F.struct(now_ms.alias("_now"), *order, F.col("hash").alias("_hash"))
    new = changed.groupBy("topic").agg(F.max(place).alias("_last")).select("topic", "_last._hash", "_last._now")
    merged = published.join(new, "topic", "full_outer")
    return merged.select(
        "topic",
        F.coalesce("_hash", "hash").alias("hash"),
        F.coalesce("_now", "updated_at").alias("updated_at"),
        F.coalesce("created_at", "_now").alias("created_at"),
    )


def not_expired(published: DataFrame, as_of_ms: int | Column, ttl_ms: int = DAY_MS) -> DataFrame:
    """Entries younger than the time to live, judged by their creation time."""
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    old = (F.col("created_at") > 0) & (F.col("created_at") <= as_of - F.lit(ttl_ms))
    return published.filter(~old)


def cap_entries(published: DataFrame, max_entries: int) -> DataFrame:
    """Keep the newest entries by creation time; the cap is the feature."""
    return first_rows(published, "created_at", ["topic"], max_entries, descending=True)


def tracked_count(published: DataFrame) -> DataFrame:
    return published.agg(F.count(F.lit(1)).alias("tracked_topics"))
