"""Alert expressions over samples.

``samples`` has name, label columns, ts (epoch ms, on a fixed step) and value: one row
per series and step. Work per series is therefore bounded by the time line.
A trailing range is the sum up to a step less the sum up to the step one range before. Each
sample enters its series twice, at its own step and one range later, so the work does not grow
with the number of steps in a range; steps between two such instants repeat the last result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _series(labels: list[str]) -> list[str]:
    return ["name", *labels]


def with_increase(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Add ``step_increase`` of a counter; a drop counts as a restart from zero."""
    over = Window.partitionBy(*_series(labels)).orderBy("ts")
    before = F.lag("value").over(over)
    grown = F.when(before.isNull(), None).when(F.col("value") < before, F.col("value"))
    return samples.withColumn("step_increase", grown.otherwise(F.col("value") - before))


def trailing(
    rows: DataFrame, keys: list[str], range_ms: Column | int, step_ms: int, last: Column, columns: list[str]
) -> DataFrame:
    """Sum of ``columns`` over the trailing range, at each step up to ``last`` whose range holds a row.

    ``rows`` is unique in (keys, ts), its values are not negative, ``range_ms`` is one value per key. A
    sum is NULL where the range holds no value of its column. Keys may be NULL. Sums are differences of
    running sums, so fractions may be off by rounding; a range without growth gives exactly 0.
    """
    range_ms = range_ms if isinstance(range_ms, Column) else F.lit(range_ms)
    upto = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_rows": F.count(F.lit(1)).over(upto)}
    for c in columns:
        sums |= {f"_sum_{c}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto), f"_n_{c}": F.count(c).over(upto)}
    summed = rows.select(*keys, "ts", range_ms.alias("_range"), *[v.alias(k) for k, v in sums.items()])
    state = F.struct(*sums)
    empty = F.lit(None).cast(summed.select(state).schema[0].dataType)
    two = F.inline(F.array(
        F.struct("ts", state.alias("now"), empty.alias("then")),
        F.struct((F.col("ts") + F.col("_range")).alias("ts"), empty.alias("now"), state.alias("then")),
    ))
    instants = summed.select(*keys, two).groupBy(*keys, "ts").agg(F.max("now").alias("now"), F.max("then").alias("then"))
    order = Window.partitionBy(*keys).orderBy("ts")
    filled = instants.select(
        *keys,
        "ts",
        F.lead("ts").over(order).alias("_until"),
        F.last("now", ignorenulls=True).over(upto).alias("now"),
        F.last("then", ignorenulls=True).over(upto).alias("then"),
    )

    def grown(name: str) -> Column:
        return F.col(f"now.{name}") - F.coalesce(F.col(f"then.{name}"), F.lit(0))

    steps = F.sequence(F.col("ts"), F.least(F.col("_until") - step_ms, F.col("_last")), F.lit(step_ms))
    return (
        filled.withColumn("_last", last)
        .filter((F.col("ts") <= F.col("_last")) & (F.col("_until") > F.col("ts")) & (grown("_rows") > 0))
        .select(
            *keys,
            F.explode(steps).alias("ts"),
            *[F.when(grown(f"_n_{c}") > 0, grown(f"_sum_{c}")).alias(c) for c in columns],
        )
    )


def increase(samples: DataFrame, labels: list[str], range_ms: int, step_ms: int) -> DataFrame:
    """Counter increase and per-second rate over the trailing range, without extrapolation."""
    last = samples.agg(F.max("ts")).scalar()
    grown = with_increase(samples, labels).filter("step_increase IS NOT NULL")
    grown = grown.withColumnRenamed("step_increase", "increase")
    return trailing(grown, _series(labels), range_ms, step_ms, last, ["increase"]).withColumn(
        "rate", F.col("increase") / F.lit(range_ms / 1000.0)
    )


def changes(samples: DataFrame, labels: list[str], range_ms: int, step_ms: int) -> DataFrame:
    """Number of value changes within the trailing range."""
    last = samples.agg(F.max("ts")).scalar()
    over = Window.partitionBy(*_series(labels)).orderBy("ts")
    # The first sample is no change, but its range holds a sample.
    changed = F.coalesce((F.col("value") != F.lag("value").over(over)).cast("int"), F.lit(0))
    flagged = samples.withColumn("changes", changed)
    return trailing(flagged, _series(labels), range_ms, step_ms, last, ["changes"])


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation.

    ``buckets`` has ``le`` and ``cumulative`` per key; the number of bounds is fixed.
    """
    over = Window.partitionBy(*keys).orderBy("le")
    total = F.max("cumulative").over(Window.partitionBy(*keys))
    rows = buckets.select(
        *keys,
        "le",
        "cumulative",
        F.lag("le").over(over).alias("_lo"),
        F.coalesce(F.lag("cumulative").over(over), F.lit(0)).alias("_below"),
        (F.lit(q) * total).alias("_rank"),
        total.alias("_total"),
    )
    infinite = F.col("le") == float("inf")
    lo = F.coalesce("_lo", F.lit(0.0))
    inside = lo + (F.col("le") - lo) * (F.col("_rank") - F.col("_below")) / (
        F.col("cumulative") - F.col("_below")
    )
    value = F.when(infinite, F.col("_lo")).otherwise(inside)
    hit = (F.col("cumulative") >= F.col("_rank")) & (F.col("_below") < F.col("_rank"))
    return rows.filter(hit & (F.col("_total") > 0)).select(*keys, value.alias("quantile"))


def ratio(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ratio of two results on shared keys; NULL where the divisor is zero."""
    joined = left.select(*keys, F.col(value).alias("_a")).join(
        right.select(*keys, F.col(value).alias("_b")), keys
    )
    return joined.select(*keys, F.try_divide("_a", "_b").alias("ratio"))


def all_of(conditions: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys at which every condition holds."""
    out = conditions[0].select(*keys).distinct()
    for condition in conditions[1:]:
        out = out.join(condition.select(*keys), keys, "left_semi")
    return out


def held_for(holding: DataFrame, keys: list[str], step_ms: int, for_ms: Column | int) -> DataFrame:
    """Steps at which the condition has held without a break for ``for_ms``."""
    for_ms = for_ms if isinstance(for_ms, Column) else F.lit(for_ms)
    over = Window.partitionBy(*keys).orderBy("ts")
    island = F.col("ts") - F.row_number().over(over).cast("bigint") * step_ms
    marked = holding.withColumn("_island", island)
    start = F.min("ts").over(Window.partitionBy(*keys, "_island"))
    return (
        marked.withColumn("active_since", start)
        .filter(F.col("ts") - F.col("active_since") >= for_ms)
        .drop("_island")
    )


# Rule, severity, seconds the condition must hold, and its terms, each
# (kind, counter or gauge, label filter, range in seconds, operator, threshold).
RULES = [
    ("DriftDetectedHigh", "warning", 0, [("increase", "streaming_drift_detected_total", "high", 300, ">", 0)]),
    ("DriftDetectedCritical", "critical", 0, [("increase", "streaming_drift_detected_total", "critical", 300, ">", 0)]),
    ("HighDriftAnomalyScore", "warning", 300, [("gauge", "streaming_drift_anomaly_score", None, 0, ">", 0.8)]),
    ("FidelityDrop", "warning", 600, [("gauge", "fidelity_overall", None, 0, "<", 0.8)]),
    ("CriticalFidelityDrop", "critical", 300, [("gauge", "fidelity_overall", None, 0, "<", 0.5)]),
    ("HighEntropyLoss", "info", 600, [("gauge", "fidelity_entropy_loss", None, 0, ">", 0.3)]),
    ("HighDriftEventRate", "warning", 300, [("rate", "drift_events_total", None, 300, ">", 0.1)]),
    ("AssetsGoingOffline", "warning", 0, [("increase", "asset_lifecycle_events_total", "offline", 300, ">", 5)]),
    ("HighStaleAssetCount", "warning", 900, [("gauge", "assets_stale", None, 0, ">", 10)]),
    ("AllAssetsOffline", "critical", 300, [("gauge", "assets_online", None, 0, "==", 0), ("gauge", "assets_gone", None, 0, ">", 0)]),
    ("HighErrorRate", "critical", 300, [("rate", "errors_total", None, 300, ">", 0.167)]),
    ("BidirectionalWriteFailures", "warning", 0, [("increase", "bidirectional_writes_total", "failure", 300, ">", 5)]),
    ("HighWriteRetryRate", "warning", 300, [("rate", "aas_write_retries_total", None, 300, ">", 0.1)]),
    ("ValidationDenialSpike", "warning", 0, [("increase", "bidirectional_validations_total", "denied", 300, ">", 20)]),
    ("HighValidationErrorRate", "warning", 300, [("rate", "validation_errors_total", None, 300, ">", 0.1)]),
    ("SparkplugBirthFailure", "warning", 0, [("increase", "errors_total", "sparkplug_birth", 300, ">", 0)]),
    ("LowThroughput", "warning", 600, [("rate", "uns_published_total", None, 600, "<", 0.017), ("gauge", "mqtt_connected", None, 0, "==", 1), ("gauge", "tracked_topics", None, 0, ">", 0)]),
    ("NoActiveDevices", "warning", 300, [("gauge", "active_devices", None, 0, "==", 0), ("gauge", "mqtt_connected", None, 0, "==", 1)]),
    ("BridgeNotPublishing", "critical", 1800, [("rate", "uns_published_total", None, 1800, "==", 0), ("rate", "sparkplug_data_total", None, 1800, "==", 0), ("gauge", "mqtt_connected", None, 0, "==", 1)]),
    ("NoBirthMessagesPublished", "warning", 3600, [("increase", "sparkplug_births_total", None, 3600, "==", 0), ("gauge", "mqtt_connected", None, 0, "==", 1), ("gauge", "active_devices", None, 0, "==", 0)]),
    ("LowSemanticCacheHitRate", "info", 900, [("ratio", "semantic_cache_hits_total", None, 300, "<", 0.5)]),
]
# The counters whose sum divides a ratio term.
RATIO_TOTALS = {"semantic_cache_hits_total": ["semantic_cache_hits_total", "semantic_cache_misses_total"]}


def rule_terms(spark, rules=None, scale: int = 1) -> DataFrame:
    """The rule catalogue as one row per term; ``scale`` stretches ranges and holds."""
    rows = []
    for rule, severity, hold, terms in rules or RULES:
        for i, (kind, metric, label, span, op, threshold) in enumerate(terms):
            sources = [(m, "total") for m in RATIO_TOTALS[metric]] + [(metric, "part")] if kind == "ratio" else [(metric, "part")]
            for source, role in sources:
                rows.append((rule, severity, hold * scale * 1000, len(terms), i, kind, source, role,
                             label, span * scale * 1000, op, float(threshold)))
    ddl = ("rule STRING, severity STRING, for_ms BIGINT, terms INT, term INT, kind STRING, name STRING, "
           "role STRING, label STRING, range_ms BIGINT, op STRING, threshold DOUBLE")
    return spark.createDataFrame(rows, ddl)


def evaluate(samples: DataFrame, terms: DataFrame, step_ms: int) -> DataFrame:
    """Firing rules: (rule, severity, instance, ts, active_since).

    ``samples`` has name, instance, label, ts and value. Terms of a rule are compared
    per instance and step; a rule holds where all its terms do.
    """
    last = samples.agg(F.max("ts")).scalar()
    grown = with_increase(samples, ["instance", "label"])
    # The catalogue is a fixed list of some thirty rows.
    wanted = F.broadcast(terms.withColumnRenamed("label", "_wanted"))
    joined = grown.join(wanted, "name").filter(
        F.col("_wanted").isNull() | (F.col("_wanted") == F.col("label"))
    )
    gauge = F.col("kind") == "gauge"
    part = F.col("role") == "part"
    term = ["rule", "severity", "for_ms", "terms", "term", "kind", "op", "threshold", "range_ms", "instance"]
    gauges = joined.filter(gauge).groupBy(*term, "ts").agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"))
    counters = (
        joined.filter(~gauge & F.col("step_increase").isNotNull())
        .groupBy(*term, "ts")
        .agg(
            F.sum(F.when(part, F.col("step_increase"))).alias("_part"),
            F.sum(F.when(~part, F.col("step_increase"))).alias("_total"),
        )
    )
    reach = F.greatest(F.col("range_ms"), F.lit(step_ms))
    ranges = trailing(counters, term, reach, step_ms, last, ["_part", "_total"])
    per_term = ranges.unionByName(gauges, allowMissingColumns=True)
    # Of several gauge series of an instance one that meets the threshold is enough.
    low = F.col("op") == "<"
    value = (
        F.when(gauge & low, F.col("_lo"))
        .when(gauge, F.col("_hi"))
        .when(F.col("kind") == "increase", F.col("_part"))
        .when(F.col("kind") == "rate", F.col("_part") / (F.col("range_ms") / 1000.0))
        .otherwise(F.try_divide("_part", "_total"))
    )
    limit = F.col("threshold")
    holds = (
        F.when(F.col("op") == ">", value > limit)
        .when(low, value < limit)
        .otherwise(value == limit)
    )
    keys = ["rule", "severity", "for_ms", "instance"]
    holding = (
        per_term.filter(holds)
        .groupBy(*keys, "terms", "ts")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == F.col("terms"))
        .select(*keys, "ts")
    )
    return held_for(holding, keys, step_ms, F.col("for_ms")).select(
        "rule", "severity", "instance", "ts", "active_since"
    )
