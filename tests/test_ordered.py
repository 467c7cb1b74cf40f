import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantweave.operators import ordered, throttle


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, and many rows share an instant."""
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(0, 40_000), i) for i in range(3000)]
    return spark.createDataFrame(data, "k string, ts bigint, i bigint").cache()


def test_lag_and_running_equal_plain_windows(rows):
    w = Window.partitionBy("k").orderBy("ts", "i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("*", F.lag("i").over(w).alias("p"), F.max("i").over(before).alias("m"), (F.row_number().over(w) - 1).alias("n"))
    got = ordered.lag_in_order(rows, ["k"], ["ts", "i"], "ts", {"p": "i"}, width_ms=700)
    got = ordered.running_before(got, ["k"], ["ts", "i"], "ts", {"m": ("max", F.col("i"))}, width_ms=900)
    got = ordered.number_in_order(got, ["k"], ["ts", "i"], "ts", "n", width_ms=1100)
    columns = ["k", "ts", "i", "p", "m", "n"]
    assert sorted(map(str, want.select(columns).collect())) == sorted(map(str, got.select(columns).collect()))


def test_global_numbers(rows):
    got = ordered.number_globally(rows.select("ts", "i"), ["ts", "i"], "n").collect()
    want = sorted((r.ts, r.i) for r in got)
    assert [(r.ts, r.i) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(3000))


@pytest.mark.parametrize("cooldown, width", [(500, 1000), (500, 5000), (5000, 1000), (1, 100), (100_000, 2000), (700, 2), (3, 2), (1, 1)])
def test_cooldown_equals_sequential_rule(rows, cooldown, width):
    want = set()
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.k, set()).add(r.ts)
    for k, times in by_key.items():
        last = None
        for t in sorted(times):
            if last is None or t - last >= cooldown:
                want.add((k, t))
                last = t
    got = throttle.cooldown_times(rows, ["k"], "ts", cooldown, slice_ms=width).collect()
    assert {(r.k, r.ts) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("slices", [64, 512, 4096])
def test_cooldown_tree_of_evenly_spaced_rows(spark, slices):
    """Chains that never meet: a task of the tree reads a bounded number of steps, however many slices the key has."""
    cooldown, width, apart = 100, 1200, 50  # two chains per slice
    ts = spark.range(slices * width // apart).select(F.lit("hot").alias("k"), (F.col("id") * apart).alias("ts"))
    rows = ts.select("k", F.col("ts").alias("_ts"), ordered.time_slice(F.col("ts"), width).alias("_slice"))
    most = [
        max(r["count"] for r in level.groupBy("k", "_parent").count().collect())
        for level in throttle._levels(rows, ["k"], cooldown, width)
    ]
    assert most[0] <= 64 * 3 and most[1] <= 64 * 3 and most[2] <= 3 * -(-slices // 4096)
    got = sorted(r.ts for r in throttle.cooldown_times(ts, ["k"], "ts", cooldown, slice_ms=width).collect())
    assert got == list(range(0, slices * width, cooldown))


def test_cooldown_of_one_dense_key(spark):
    """Two million rows of one key a second apart; no array of times is built on the way."""
    n, cooldown = 2_000_000, 300_500
    rows = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 1000).alias("ts"))
    want, last = [], None
    for t in range(0, n * 1000, 1000):
        if last is None or t - last >= cooldown:
            want.append(t)
            last = t
    out = throttle.cooldown_times(rows, ["k"], "ts", cooldown)
    assert sorted(r.ts for r in out.collect()) == want
    assert "collect_" not in out._jdf.queryExecution().toString()


def test_latest_and_top(rows):
    last = ordered.latest_per_key(rows, ["k"], ["ts", "i"]).collect()
    top = ordered.top_per_key(rows, ["k"], [F.col("ts").desc(), F.col("i").desc()], 1).collect()
    assert sorted(map(str, last)) == sorted(map(str, top))


@pytest.mark.parametrize("descending", [False, True])
def test_first_rows_equal_a_sort(spark, descending):
    """Many rows share a key, some have none, keys are far apart."""
    rng = random.Random(11)
    keys = [None, 5, 5, -3, 1_700_000_000_000, *(rng.randrange(10**12) for _ in range(40))]
    data = [(rng.choice(keys), f"t{i:04}") for i in range(600)]
    df = spark.createDataFrame(data, "k bigint, t string").repartition(4).checkpoint()
    least = min(k for k, _ in data if k is not None) - 1
    sign = -1 if descending else 1
    want = sorted(data, key=lambda r: (sign * (least if r[0] is None else r[0]), r[1]))
    for n in (0, 1, 7, 333, 599, 600, 900):
        got = [tuple(r) for r in ordered.first_rows(df, "k", ["t"], n, descending).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want[:n]))


def test_first_rows_of_few_keys(spark):
    nothing = spark.createDataFrame([], "k bigint, t string")
    assert ordered.first_rows(nothing, "k", ["t"], 3).count() == 0
    same = spark.range(500).select(F.lit(None).cast("bigint").alias("k"), F.format_string("%05d", "id").alias("t"))
    assert sorted(r.t for r in ordered.first_rows(same, "k", ["t"], 20).collect()) == [f"{i:05}" for i in range(20)]
