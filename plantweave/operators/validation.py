"""Semantic validation of metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element types that must carry an identifier by default.
REQUIRED_TYPES = ["Property", "Range", "Range.min", "Range.max"]


def _error(kind: str, message: Column, expected: Column, actual: Column, with_id: bool = True):
    sid = F.col("semantic_id") if with_id else F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("error_type"),
        message.alias("message"),
        F.col("path").alias("path"),
        sid.alias("semantic_id"),
        expected.alias("expected"),
        actual.alias("actual"),
    )


def validate(
    metrics: DataFrame,
    constraints: DataFrame,
    required_types: list[str] | None = None,
    enforce_semantic_ids: bool = True,
) -> DataFrame:
    """Add ``errors``, an array of error structs, to each metric row."""
    required = REQUIRED_TYPES if required_types is None else required_types
    no_id = F.nullif(F.col("semantic_id"), F.lit("")).isNull()
    num, low, high = F.col("value_num"), F.col("min_value"), F.col("max_value")
    unit, wanted, pattern = F.col("unit"), F.col("unit_expected"), F.col("pattern")
    shown = lambda c: c.cast("string")
    is_text = num.isNull() & F.col("value_json").startswith('"')
    checks = [
        F.when(
            F.lit(enforce_semantic_ids) & F.col("aas_type").isin(required) & no_id,
            _error(
                "missing_semantic_id",
                F.concat(F.col("aas_type"), F.lit(" element requires a semantic ID")),
                F.lit("non-empty semantic ID"),
                F.lit("None"),
                with_id=False,
            ),
        ),
        F.when(
            num < low,
            _error(
                "value_out_of_range",
                F.concat(F.lit("Value "), shown(num), F.lit(" is below minimum "), shown(low)),
                F.concat(F.lit(">= "), shown(low)),
                shown(num),
            ),
        ),
        F.when(
            num > high,
            _error(
                "value_out_of_range",
                F.concat(F.lit("Value "), shown(num), F.lit(" exceeds maximum "), shown(high)),
                F.concat(F.lit("<= "), shown(high)),
                shown(num),
            ),
        ),
        F.when(
            wanted.isNotNull() & ~unit.eqNullSafe(wanted),
            _error(
                "unit_mismatch",
                F.concat(
                    F.lit("Unit '"),
                    F.coalesce(unit, F.lit("None")),
                    F.lit("' does not match expected '"),
                    wanted,
                    F.lit("'"),
                ),
                wanted,
                F.coalesce(F.nullif(unit, F.lit("")), F.lit("None")),
            ),
        ),
        F.when(
            pattern.isNotNull()
            & is_text
            & ~F.rlike(F.col("value"), F.concat(F.lit("^(?:"), pattern, F.lit(")"))),
            _error(
                "pattern_mismatch",
                F.concat(
                    F.lit("Value '"), F.col("value"), F.lit("' does not match pattern '"), pattern, F.lit("'")
                ),
                pattern,
                F.col("value"),
            ),
        ),
    ]
    joined = metrics.join(constraints, "semantic_id", "left")
    return joined.select(*metrics.columns, F.array_compact(F.array(*checks)).alias("errors"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid metric rows, one row per error)."""
    valid = validated.filter(F.size("errors") == 0).drop("errors")
    errors = validated.select("asset_id", "submodel", "timestamp_ms", F.inline("errors"))
    return valid, errors


def batch_result(validated: DataFrame) -> DataFrame:
    """Valid, invalid and error totals per submodel of an asset."""
    return validated.groupBy("asset_id", "submodel").agg(
        F.count_if(F.size("errors") == 0).alias("valid_count"),
        F.count_if(F.size("errors") > 0).alias("invalid_count"),
        F.sum(F.size("errors")).cast("bigint").alias("total_errors"),
    )


def enforce(
    metrics: DataFrame, constraints: DataFrame, level: int = 1, reject_invalid: bool = False
) -> DataFrame:
    """Level 0 passes rows through; 1 and 2 check them and may reject the invalid ones.

    Level 2 also marks the rows that carry user properties.
    """
    if level == 0:
        return metrics.withColumn("use_properties", F.lit(False))
    validated = validate(metrics, constraints)
    if reject_invalid:
        validated = validated.filter(F.size("errors") == 0)
    return validated.drop("errors").withColumn("use_properties", F.lit(level >= 2))


def counts(validated: DataFrame) -> DataFrame:
    """(kind, label, n): rows by result and errors by type."""
    by_result = validated.groupBy(
        F.lit("result").alias("kind"),
        F.when(F.size("errors") == 0, "valid").otherwise("invalid").alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))
    by_type = (
        validated.select(F.explode("errors.error_type").alias("label"))
        .groupBy(F.lit("error_type").alias("kind"), "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return by_result.unionByName(by_type)
