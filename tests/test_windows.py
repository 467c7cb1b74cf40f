"""Windows of the anomaly score as one stream: totals per tree, large days, gaps and nulls."""

import re

import pytest
from pyspark.sql import functions as F

from plantweave.operators import anomaly

DAY = anomaly.DAY_MS
SHAPE = {"trees": 4, "depth": 5, "window": 7}


@pytest.fixture
def metrics(metric_rows):
    rows = [
        {"asset_id": f"a{i % 3}", "path": f"S.p{i % 4}", "value_num": float(i * 37 % 101), "elem_order": f"{i:06d}",
         "timestamp_ms": (i % 5) * DAY + i, "unit": "m" if i % 2 else None, "value_type": None if i % 3 == 2 else "xs:double"}
        for i in range(400)
    ]
    rows += [{"asset_id": "gap", "elem_order": f"9{d}", "timestamp_ms": d * DAY} for d in (0, 2)]
    return metric_rows(*rows, {"asset_id": None, "elem_order": "99"})


def _sorted(df):
    return sorted(df.collect(), key=str)


def test_large_days_give_the_same_scores_and_masses(metrics, monkeypatch):
    scores = {m: _sorted(anomaly.score(metrics, mode=m, **SHAPE)) for m in ("windowed", "cumulative")}
    masses = _sorted(anomaly.reference_mass(metrics, **SHAPE))
    monkeypatch.setattr(anomaly, "SALT_ROWS", 9)
    monkeypatch.setattr(anomaly, "_SLICE_ROWS", 7)
    for mode, want in scores.items():
        assert _sorted(anomaly.score(metrics, mode=mode, **SHAPE)) == want
    assert _sorted(anomaly.reference_mass(metrics, **SHAPE)) == masses
    lonely = [r for r in scores["windowed"] if r.asset_id in (None, "gap")]
    assert len(lonely) == 3 and all(r.anomaly_score == 0.5 and r.observations == 0 for r in lonely)


def test_totals_are_sums_over_the_nodes(metrics):
    mass = anomaly.reference_mass(metrics, **SHAPE)
    sums = mass.groupBy("asset_id", "window", "tree").agg(
        F.count("*").alias("nodes"), F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("node")).alias("weighted"))
    assert _sorted(anomaly.tree_totals(metrics, **SHAPE)) == _sorted(sums)


def test_rows_of_ordinary_days_are_not_multiplied_by_nodes(metrics):
    """Where no day is large, the plan that ran has no step that makes a row per node or tree."""
    for df in (anomaly.reference_mass(metrics, **SHAPE).groupBy("asset_id").agg(F.sum("mass")), anomaly.score(metrics, **SHAPE)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert not re.search(r"explode\(pythonUDF", plan)
