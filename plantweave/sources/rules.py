"""Rule tables: hierarchy mapping and value constraints."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def _rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table from driver-side rows, broadcast when their number allows it."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


@dataclass
class MappingRules:
    """Default levels, a table of exact rules and the ordered glob patterns."""

    default: dict
    exact: DataFrame
    patterns: list[dict] = field(default_factory=list)


LEVELS_DDL = "enterprise STRING, site STRING, area STRING, line STRING, asset STRING"


def mapping_rules(spark: SparkSession, config: dict | None) -> MappingRules:
    """Rules from a parsed mapping file; an empty one means enterprise ``Default``."""
    config = config or {}
    default = config.get("default") or {"enterprise": "Default"}
    rows = [
        (asset, *[levels.get(k, "") for k in ("enterprise", "site", "area", "line", "asset")])
        for asset, levels in (config.get("assets") or {}).items()
    ]
    exact = _rule_table(spark, rows, f"asset_id STRING, {LEVELS_DDL}")
    return MappingRules(default, exact, list(config.get("patterns") or []))


CONSTRAINTS_DDL = (
    "semantic_id STRING, min_value DOUBLE, max_value DOUBLE, unit_expected STRING, pattern STRING"
)


def constraint_rules(spark: SparkSession, constraints: dict[str, dict]) -> DataFrame:
    """Constraint table keyed by semantic id; patterns that do not compile are dropped."""

    def usable(pattern: str | None) -> str | None:
        try:
            re.compile(pattern or "")
        except re.error:
            return None
        return pattern or None

    rows = [
        (sid, _double(c.get("min")), _double(c.get("max")), c.get("unit") or None, usable(c.get("pattern")))
        for sid, c in constraints.items()
    ]
    return _rule_table(spark, rows, CONSTRAINTS_DDL)


def _double(value) -> float | None:
    return None if value is None else float(value)
