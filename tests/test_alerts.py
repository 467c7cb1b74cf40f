"""Trailing ranges against plain loops."""

import random

import pytest

from plantweave.operators import alerts

STEP = 15_000
DDL = "name string, instance string, label string, ts bigint, value double"


@pytest.fixture(scope="module")
def samples(spark):
    """Series with gaps, restarts, one sample only and no label; rows come in any order."""
    rng = random.Random(2)
    rows = []
    for series in [("c", "i1", "a"), ("c", "i1", None), ("c", "i2", "a"), ("d", "i1", "a")]:
        value = 0.0
        for step in range(120):
            value = 0.0 if rng.random() < 0.05 else value + rng.choice([0, 0, 1, 2.5, 40])
            if rng.random() > 0.3 and not 50 < step < 80:
                rows.append((*series, step * STEP, value))
    rows.append(("c", "lone", "a", 60 * STEP, 3.0))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DDL).repartition(3)


def by_series(samples):
    series = {}
    for r in sorted(samples.collect(), key=lambda r: r.ts):
        series.setdefault((r.name, r.instance, r.label), []).append((r.ts, r.value))
    return series, max(r.ts for r in samples.collect())


@pytest.mark.parametrize("steps", [1, 2, 7, 100, 1000])
def test_ranges_equal_plain_loops(samples, steps):
    series, last = by_series(samples)
    grown, changed = {}, {}
    for key, rows in series.items():
        for ts in range(0, last + 1, STEP):
            inside = [i for i, (t, _) in enumerate(rows) if ts - steps * STEP < t <= ts]
            pairs = [(rows[i - 1][1], rows[i][1]) for i in inside if i > 0]
            if pairs:
                grown[(*key, ts)] = sum(b if b < a else b - a for a, b in pairs)
            if inside:
                changed[(*key, ts)] = sum(a != b for a, b in pairs)
    labels, span = ["instance", "label"], steps * STEP
    got = alerts.increase(samples, labels, span, STEP).collect()
    assert {(r.name, r.instance, r.label, r.ts): r.increase for r in got} == grown and len(got) == len(grown)
    assert all(r.rate == pytest.approx(r.increase / (span / 1000)) for r in got)
    got = alerts.changes(samples, labels, span, STEP).collect()
    assert {(r.name, r.instance, r.label, r.ts): r.changes for r in got} == changed and len(got) == len(changed)


def test_fractions_without_growth_give_exactly_zero(spark):
    """Running sums of tenths are not exact, but a range in which nothing grows is."""
    rows = [("c", "i", "a", i * STEP, min(i, 200) * 0.1) for i in range(260)]
    got = alerts.increase(spark.createDataFrame(rows, DDL), ["instance", "label"], 10 * STEP, STEP).collect()
    assert {r.ts: r.increase for r in got if r.ts >= 210 * STEP} == {i * STEP: 0.0 for i in range(210, 260)}
    assert all(abs(r.increase - 1.0) < 1e-9 for r in got if 10 * STEP <= r.ts <= 200 * STEP)


def test_no_samples(spark):
    empty = spark.createDataFrame([], DDL)
    assert alerts.increase(empty, ["instance", "label"], 5 * STEP, STEP).count() == 0
    assert alerts.evaluate(empty, alerts.rule_terms(spark), STEP).count() == 0


def test_rows_do_not_grow_with_the_range(samples):
    """One exchange by series serves sums, instants and steps."""
    plan = alerts.changes(samples, ["instance", "label"], 1000 * STEP, STEP)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(name") == 1
