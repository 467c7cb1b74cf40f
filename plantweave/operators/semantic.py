"""Context dimension: register, resolve and distribute semantic contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.functions import semantics
from plantweave.operators.mapping import context_topic
from plantweave.operators.ordered import latest_per_key

CONTEXT_COLUMNS = [
    "hash",
    "semantic_id",
    "dictionary",
    "version",
    "definition",
    "preferred_name",
    "unit",
    "data_type",
    "hierarchy",
]


def contexts_of_metrics(metrics: DataFrame) -> DataFrame:
    """One context row per metric that has an identifier, with its time and order."""
    sid = F.col("semantic_id")
    text = F.lit(None).cast("string")
    return metrics.filter(sid.isNotNull() & (sid != "")).select(
        semantics.pointer_hash(sid).alias("hash"),
        "semantic_id",
        semantics.dictionary(sid).alias("dictionary"),
        semantics.version(sid).alias("version"),
        text.alias("definition"),
        text.alias("preferred_name"),
        "unit",
        F.col("value_type").alias("data_type"),
        semantics.hierarchy(sid, F.col("semantic_keys")).alias("hierarchy"),
        "timestamp_ms",
        "elem_order",
    )


def register(candidates: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """New context rows: the first candidate per hash that is not registered yet."""
    rest = [c for c in CONTEXT_COLUMNS if c != "hash"]
    first = (
        candidates.groupBy("hash")
        .agg(F.min_by(F.struct(*rest), F.struct("timestamp_ms", "elem_order")).alias("c"))
        .select("hash", "c.*")
    )
    if contexts is not None:
        first = first.join(contexts.select("hash"), "hash", "left_anti")
    return first.select(*CONTEXT_COLUMNS)


def resolve(pointers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Context columns for each ``hash``; NULL where the hash is unknown."""
    return pointers.join(contexts, "hash", "left")


def resolve_by_semantic_id(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Pointer (hash, dictionary, version) for each ``semantic_id``."""
    return rows.join(
        contexts.select("semantic_id", "hash", "dictionary", "version"), "semantic_id", "left"
    )


def registered(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows whose hash is registered."""
    return rows.join(contexts.select("hash"), "hash", "left_semi")


def publish_contexts(
    contexts: DataFrame, prefix: str, published: DataFrame | None = None
) -> DataFrame:
    """Retained rows (topic, payload) for contexts not yet published.

    Without ``published`` every context is sent again.
    """
    once = contexts.dropDuplicates(["hash"])
    if published is not None:
        once = once.join(published.select("hash"), "hash", "left_anti")
    ctx = {c: F.col(c) for c in CONTEXT_COLUMNS}
    return once.select(
        "hash",
        context_topic(prefix, F.col("dictionary"), F.col("hash")).alias("topic"),
        semantics.context_json(ctx).alias("payload"),
    )


def clear_contexts(contexts: DataFrame, prefix: str) -> DataFrame:
    """Tombstones for contexts: a NULL payload removes the retained row."""
    return contexts.select(
        "hash",
        context_topic(prefix, F.col("dictionary"), F.col("hash")).alias("topic"),
        F.lit(None).cast("string").alias("payload"),
    )


def find_or_create(
    metrics: DataFrame, contexts: DataFrame, prefix: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics with pointer columns, new context rows, rows to distribute)."""
    new = register(contexts_of_metrics(metrics), contexts)
    known = contexts.select(*CONTEXT_COLUMNS).unionByName(new)
    return resolve_by_semantic_id(metrics, known), new, publish_contexts(new, prefix)
