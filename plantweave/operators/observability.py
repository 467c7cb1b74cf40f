"""Counters, gauges and histograms as sample rows, and the status row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Histogram bounds in seconds.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]


def counter_samples(
    rows: DataFrame, name: str, labels: list[str], ts: str, step_ms: int
) -> DataFrame:
    """Cumulative count per label set at every step from the first row to the last.

    One row per series and step, so the running sum works on the time line and not
    on the rows that were counted.
    """
    step = (F.col(ts) - F.pmod(F.col(ts), F.lit(step_ms))) + step_ms
    counted = rows.groupBy(*labels, step.alias("ts")).agg(F.count(F.lit(1)).alias("_n"))
    span = counted.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    grid = (
        counted.select(*labels)
        .distinct()
        .withColumn("_span", span)
        .select(
            *labels, F.explode(F.sequence("_span.lo", "_span.hi", F.lit(step_ms))).alias("ts")
        )
    )
    running = Window.partitionBy(*labels).orderBy("ts")
    filled = grid.join(counted, [*labels, "ts"], "left")
    return filled.select(
        F.lit(name).alias("name"),
        *labels,
        "ts",
        F.sum(F.coalesce("_n", F.lit(0))).over(running).cast("double").alias("value"),
    )


def gauge_last(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Latest value per series."""
    return samples.groupBy("name", *labels).agg(F.max_by("value", "ts").alias("value"))


def histogram(
    rows: DataFrame, labels: list[str], value: str, bounds: list[float]
) -> DataFrame:
    """Cumulative buckets: per label set and bound the number of values up to it."""
    counts = rows.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("_inf"),
    )
    buckets = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_inf").alias("cumulative")))
    return counts.select(*labels, F.inline(F.array(*buckets)))


def status_row(messages: DataFrame, published: DataFrame, as_of: Column, online_within_ms: int) -> DataFrame:
    """One row: health, last message, active devices, births and published topics."""
    from plantweave.operators.messages import active_devices

    devices = active_devices(messages).agg(F.count(F.lit(1))).scalar()
    topics = published.agg(F.count(F.lit(1))).scalar()
    connected = F.coalesce(F.max("ts") >= as_of - online_within_ms, F.lit(False))
    return messages.agg(
        F.when(connected, "healthy").otherwise("degraded").alias("status"),
        connected.alias("connected"),
        F.count_if(F.col("kind").isin("NBIRTH", "DBIRTH")).alias("births"),
    ).select(
        "status", "connected", devices.alias("active_devices"), "births", topics.alias("published")
    )
