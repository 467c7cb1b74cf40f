"""Plant hierarchy and topics of assets and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantweave.functions import text
from plantweave.operators.ordered import latest_per_key
from plantweave.sources.rules import MappingRules

LEVELS = ["enterprise", "site", "area", "line", "asset"]


def _clean(value: Column) -> Column:
    filled = F.coalesce(value, F.lit(""))
    return F.when(filled == "", "").otherwise(text.sanitize_segment(value))


def _clean_levels() -> Column:
    """Clean levels of a rule row; the enterprise is always filled."""
    rest = [_clean(F.col(level)).alias(level) for level in LEVELS[1:]]
    return F.struct(text.sanitize_segment(F.col("enterprise")).alias("enterprise"), *rest)


def with_identity(rows: DataFrame, rules: MappingRules) -> DataFrame:
    """Add the hierarchy levels of ``asset_id``; NULL levels where there is no asset.

    Exact rules win over patterns, the first matching pattern over later ones, and
    the default takes the rest. The levels are cleaned in the rule tables, which are
    small; the rows only look them up, so they are not shuffled.
    """
    asset = F.col("asset_id")
    exact = rules.exact.select("asset_id", _clean_levels().alias("_exact"))
    numbered = [
        (i, *[rule.get(level) or "" for level in LEVELS])
        for i, rule in enumerate([*rules.patterns, rules.default])
    ]
    ddl = "_rule INT, " + ", ".join(f"{level} STRING" for level in LEVELS)
    # As many rows as there are hand-written patterns, and the default.
    levels = rows.sparkSession.createDataFrame(numbered, ddl).select(
        "_rule", _clean_levels().alias("_levels")
    )
    hits = [
        F.when(asset.rlike(text.glob_to_regex(rule["pattern"])), F.lit(i))
        for i, rule in enumerate(rules.patterns)
    ]
    rule = F.when(asset.isNotNull(), F.coalesce(*hits, F.lit(len(rules.patterns))))
    joined = (
        rows.withColumn("_rule", rule)
        .join(exact, "asset_id", "left")
        .join(F.broadcast(levels), "_rule", "left")
        .withColumn("_chosen", F.coalesce("_exact", "_levels"))
    )
    name = F.when(F.col("_chosen.asset") != "", F.col("_chosen.asset")).when(
        asset.isNotNull(), _clean(text.last_id_part(asset))
    )
    return joined.select(
        *rows.columns,
        *[F.col(f"_chosen.{level}").alias(level) for level in LEVELS[:4]],
        name.alias("asset"),
    )


def resolve_identities(assets: DataFrame, rules: MappingRules) -> DataFrame:
    """One row of hierarchy levels per distinct asset id."""
    ids = assets.select("asset_id").filter(F.col("asset_id").isNotNull()).distinct()
    return with_identity(ids, rules)


def topic_prefix() -> Column:
    """Hierarchy levels of an identity row as a topic prefix."""
    return text.join_topic(*[F.col(level) for level in LEVELS])


def device_id() -> Column:
    """Asset level of the identity, else the submodel name."""
    return F.coalesce(F.nullif(F.col("asset"), F.lit("")), F.col("submodel"))


def with_topics(metrics: DataFrame, rules: MappingRules, root: str = "") -> DataFrame:
    """Add ``topic`` and ``device_id`` to metric rows, without a shuffle."""
    joined = with_identity(metrics, rules).withColumn(
        "_prefix", F.when(F.col("enterprise").isNotNull(), topic_prefix())
    )
    fallback = text.sanitize_segment(F.lit(rules.default.get("enterprise") or "Default"))
    lead = F.concat(F.col("submodel"), F.lit("."))
    inner = F.when(
        F.startswith(F.col("path"), lead),
        F.substring(F.col("path"), F.length(lead) + 1, F.length(F.col("path"))),
    ).otherwise(F.col("path"))
    topic = text.join_topic(
        F.lit(root.strip("/")),
        F.coalesce(F.col("_prefix"), fallback),
        F.lit("context"),
        text.sanitize_segment(F.col("submodel")),
        text.sanitize_metric_path(inner),
    )
    return joined.select(
        *metrics.columns, topic.alias("topic"), device_id().alias("device_id")
    )


def last_metric_per_topic(topic_metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of metrics that share a topic within a submodel keep the last element."""
    keys = keys or ["asset_id", "submodel", "topic"]
    return latest_per_key(topic_metrics, keys, ["elem_order", "path"])


def topic_collisions(topic_metrics: DataFrame) -> DataFrame:
    """Topics of a submodel that several paths map to."""
    return (
        topic_metrics.select("asset_id", "submodel", "topic", "path")
        .distinct()
        .groupBy("asset_id", "submodel", "topic")
        .agg(F.count(F.lit(1)).alias("paths"))
        .filter("paths > 1")
    )


def device_topic(group: str, kind: Column, node: Column, device: Column | None = None) -> Column:
    """Topic of a device message."""
    parts = [F.lit("spBv1.0"), F.lit(group), kind, node]
    return text.join_topic(*parts, *([] if device is None else [device]))


def alert_topic(prefix: str, asset_id: Column, max_length: int = 128, colons: bool = False) -> Column:
    """Alert topic of an asset: no scheme, one clean segment."""
    bare = text.without_scheme(asset_id)
    if colons:
        bare = F.replace(bare, F.lit(":"), F.lit("_"))
    return F.concat(F.lit(prefix + "/"), text.sanitize_segment(bare, max_length))


def context_topic(prefix: str, dictionary: Column, pointer: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), text.sanitize_segment(dictionary), pointer)


def match_topic_filters(topics: DataFrame, filters: list[str]) -> DataFrame:
    """(topic, filter) for every subscription filter a topic matches.

    Filters are subscriptions written by hand; each becomes one constant regular
    expression, so a topic row is read once and never joined to itself.
    """
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.col("topic").rlike(text.topic_filter_to_regex(f)), F.lit(f))
                for f in filters
            ]
        )
    )
    return topics.select("topic", F.explode(hits).alias("filter"))
