"""Score then update in batch against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantweave.operators import anomaly, online, ordered
from tests.test_streaming import forest_scores

SHAPE = (5, 4, 50, 9)


@pytest.fixture(scope="module")
def metrics(spark):
    """Most rows in one asset, many at one instant, some without a number or an asset."""
    rng = random.Random(5)
    rows = []
    for i in range(700):
        asset = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c", None])
        value = None if rng.random() < 0.05 else rng.choice([0.0, -3.5, 1e9, rng.random(), float(rng.randrange(40))])
        rows.append((asset, rng.choice(["S.p", "S.p.q[1]"]), rng.randrange(300) * 1000, f"{i:05}", value,
                     rng.choice(["xs:int", "xs:double"]), rng.choice([None, "", "s"]), rng.choice([None, "EUR"])))
    rows.append(("one", "S.p", 5, "00700", 2.0, "xs:int", None, None))
    ddl = ("asset_id string, path string, timestamp_ms bigint, elem_order string, value_num double, "
           "value_type string, semantic_id string, unit string")
    return spark.createDataFrame(rows, ddl).repartition(5).checkpoint()


@pytest.fixture(scope="module")
def wanted(metrics):
    rows = metrics.filter("value_num IS NOT NULL AND asset_id IS NOT NULL").select(
        "asset_id", "timestamp_ms", "elem_order", anomaly.features().alias("f")).collect()
    want = {}
    for asset in {r.asset_id for r in rows}:
        mine = sorted((r for r in rows if r.asset_id == asset), key=lambda r: (r.timestamp_ms, r.elem_order))
        for n, (r, score) in enumerate(zip(mine, forest_scores([r.f for r in mine], *SHAPE)), 1):
            want[r.elem_order] = (asset, n, score)
    return want


@pytest.mark.parametrize("block_rows", [1, 7, 64, 100_000])
def test_blocks_of_any_size_equal_one_loop(metrics, wanted, block_rows):
    got = online.score_then_update(metrics, *SHAPE, block_rows=block_rows).collect()
    assert len(got) == len(wanted)
    for r in got:
        asset, n, score = wanted[r.elem_order]
        assert (r.asset_id, r.observations) == (asset, n)
        assert r.anomaly_score == pytest.approx(score, abs=1e-12)


def test_results_can_be_classified(metrics):
    flagged = anomaly.classify(online.score_then_update(metrics, *SHAPE, block_rows=64), window=50)
    first = flagged.filter("elem_order = '00700'").first()
    assert (first.anomaly_score, first.is_drift, first.severity) == (0.5, True, "medium")


def test_empty_table(metrics):
    assert online.score_then_update(metrics.limit(0), *SHAPE).count() == 0
    assert ordered.slice_width(metrics.limit(0), "timestamp_ms", 10) == ordered.HOUR_MS


def test_hot_asset_spreads_over_tasks(spark):
    """No piece of the replay holds more than a few blocks of an asset that has all rows."""
    rows = spark.range(6000).select(
        F.lit("hot").alias("asset_id"), F.lit("S.p").alias("path"), F.col("id").alias("timestamp_ms"),
        F.format_string("%05d", "id").alias("elem_order"), F.rand(3).alias("value_num"), F.lit("xs:int").alias("value_type"),
        F.lit("").alias("semantic_id"), F.lit("").alias("unit"))
    coded = online._coded(rows, *SHAPE[:2], SHAPE[3], 250)
    blocks = {r.block: r["count"] for r in coded.groupBy("block").count().collect()}
    assert blocks == {b: 250 for b in range(24)}
    # Sums over blocks end in the plain counts.
    states = {r.block: r.state for r in online._states(coded.checkpoint()).collect()}
    assert set(states) == set(range(1, 24))
    for block, state in states.items():
        assert sum(s.n for s in state) == 250 * block * SHAPE[0]
        assert len(state) <= SHAPE[0] << SHAPE[1]
    assert np.ptp([len({s.code for s in state}) - len(state) for state in states.values()]) == 0
