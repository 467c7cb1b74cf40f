"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is joins and partial aggregations on small rows. Edges never leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.llm import store


def _linked_to_least(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (hi, lo): link each node's neighbours to the least node near it."""
    if both:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
    else:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if both:
        out = joined.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionAll(
            least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        )
    return out.filter("hi > lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as rows (node, root), root the least node reachable; nodes without edges are absent."""
    current = store.materialise(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "edges"
    )
    mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    while mark["n"]:
        nxt = store.materialise(_linked_to_least(_linked_to_least(current, True), False), "edges")
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        current, (mark, before) = nxt, (now, mark)
        if mark == before:
            break
    roots = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionAll(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
