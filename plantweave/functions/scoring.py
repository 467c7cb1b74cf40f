"""Score, severity and grade formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default severity thresholds and overall-score weights.
SEVERITY_THRESHOLDS = {"low": 0.3, "medium": 0.5, "high": 0.7, "critical": 0.9}
FIDELITY_WEIGHTS = {"structural": 0.3, "semantic": 0.5, "entropy": 0.2}


def entropy_loss(original: Column, kept: Column) -> Column:
    """Share of ``log2`` key entropy lost; 0 when nothing could be lost."""
    bits = lambda n: F.when(n > 1, F.log2(n)).otherwise(F.lit(0.0))
    return F.when((kept >= original) | (original <= 1), F.lit(0.0)).otherwise(
        F.lit(1.0) - bits(kept) / bits(original)
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= 0.95, "A+")
        .when(score >= 0.90, "A")
        .when(score >= 0.85, "B+")
        .when(score >= 0.80, "B")
        .when(score >= 0.70, "C")
        .when(score >= 0.60, "D")
        .otherwise("F")
    )


def severity(score: Column, thresholds: dict[str, float] | None = None) -> Column:
    t = thresholds or SEVERITY_THRESHOLDS
    return (
        F.when(score >= t["critical"], "critical")
        .when(score >= t["high"], "high")
        .when(score >= t["medium"], "medium")
        .otherwise("low")
    )


def confidence(score: Column, observations: Column, window: int) -> Column:
    """Grows with the number of observations and with the distance from 0.5."""
    return (F.lit(1.0) - F.exp(-observations / F.lit(float(window)))) * F.abs(score - 0.5) * 2


def action(drift_type: Column, level: Column, conf: Column) -> Column:
    severe = level.isin("high", "critical")
    return (
        F.when(conf < 0.3, "monitor")
        .when((drift_type == "schema_evolution") & severe, "quarantine")
        .when(drift_type == "schema_evolution", "alert")
        .when((drift_type == "value_anomaly") & (level == "critical"), "quarantine")
        .when((drift_type == "value_anomaly") & (level == "high"), "alert")
        .when(drift_type == "value_anomaly", "auto_accept")
        .when(drift_type == "concept_drift", "alert")
        .otherwise("monitor")
    )
