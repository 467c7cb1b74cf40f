"""Streams over several files give the rows of the batch operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantweave.operators import anomaly, dedup, lifecycle, throttle
from plantweave.streaming import processors, sinks


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    times = sorted(rng.sample(range(0, 50_000_000), 400))
    rows = [(rng.choice(["a", "a", "b", "c"]), t, f"{i:05d}", str(rng.randrange(3)), rng.choice(["data", "data", "death"])) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "k string, ts bigint, ord string, value_json string, kind string").cache()


@pytest.fixture
def stream(spark, data, tmp_path):
    """The rows in time order, cut into four files."""
    processors.use_rocksdb(spark)
    cuts = [0, 12_000_000, 25_000_000, 40_000_000, 60_000_000]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = data.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{i}"))
    raw = spark.readStream.schema(data.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(build, name="out"):
        return sinks.run_available(build(raw), str(tmp_path / name), str(tmp_path / f"{name}-cp"))

    run.raw, run.path = raw, tmp_path
    return run


def keys(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_cooldown(stream, data):
    got = stream(lambda s: processors.cooldown_stream(s.select("k", "ts", "ord"), 700_000))
    assert keys(got, "k", "ts") == keys(throttle.cooldown_times(data, ["k"], "ts", 700_000), "k", "ts")


@pytest.mark.parametrize("ttl", [None, 1_000_000])
def test_changed(stream, data, ttl):
    got = stream(lambda s: processors.changed_stream(s, ttl))
    if ttl is None:
        want = dedup.changed_in_series(data, "k", "ts", "ord")
    else:
        want = dedup.changed_in_series_with_ttl(data, ttl, "k", "ts", "ord")
    assert keys(got, "ord") == keys(want, "ord")


def test_lifecycle(stream, data):
    rows = data.select(F.col("k").alias("asset_id"), "ts", "kind", F.col("ord").cast("bigint").alias("seq"))
    build = lambda s: processors.lifecycle_stream(
        s.select(F.col("k").alias("asset_id"), "ts", "kind", F.col("ord").cast("bigint").alias("seq")), 300_000)
    last = data.agg(F.max("ts")).first()[0]
    columns = ["asset_id", "previous_state", "new_state", "timestamp_ms", "reason"]
    want = lifecycle.events(rows, last - 3_600_000, 300_000)
    assert keys(stream(build), *columns) == keys(want, *columns)


def test_keyed_table(spark, stream, data):
    from plantweave.operators.ordered import latest_per_key
    from plantweave.sources.sinks import KeyedTable

    schema = "k string, ts bigint, ord string, value_json string, kind string"
    table = KeyedTable(spark, str(stream.path / "table"), schema)
    sinks.run_available_batches(stream.raw, sinks.upsert_each_batch(table, ["k"], ["ts", "ord"]), str(stream.path / "cp"))
    assert keys(table.read(), "*") == keys(latest_per_key(data, ["k"], ["ts", "ord"]), "*")


def forest_scores(rows, trees, depth, window, seed):
    """Plain score-then-update over one asset's features."""
    dims, splits = anomaly.tree_arrays(trees, depth, seed)
    mass = np.zeros(dims.shape, dtype=int)
    lo = hi = None
    out = []
    for x in rows:
        def path(tree):
            node, seen = 0, []
            for _ in range(depth):
                seen.append(node)
                d = dims[tree, node]
                v = (x[d] - lo[d]) / (hi[d] - lo[d]) if hi[d] > lo[d] else 0.5
                node = 2 * node + (1 if v < splits[tree, node] else 2)
            return seen

        if lo is None:
            out.append(0.5)
            lo, hi = list(x), list(x)
        else:
            out.append(1 - sum(mass[t, n] for t in range(trees) for n in path(t)) / (trees * depth * window))
            lo, hi = [min(a, b) for a, b in zip(lo, x)], [max(a, b) for a, b in zip(hi, x)]
        for t in range(trees):
            for n in path(t):
                mass[t, n] = min(mass[t, n] + 1, window)
    return out


def _metrics(df):
    return df.select(
        F.col("k").alias("asset_id"), F.col("ts").alias("timestamp_ms"), F.col("ord").alias("elem_order"),
        (F.pmod(F.col("ts"), F.lit(997)) / 10).alias("value_num"), F.lit("S.p.q").alias("path"),
        F.when(F.col("kind") == "data", "xs:int").otherwise("xs:double").alias("value_type"),
        F.when(F.col("kind") == "data", "s").alias("semantic_id"), F.lit("m").alias("unit"),
    )


def test_anomaly_stream_equals_brute_force(stream, data):
    shape = (5, 4, 50, 9)
    got = {r.ord: r.score for r in stream(lambda s: processors.anomaly_stream(_metrics(s), *shape)).collect()}
    rows = _metrics(data).select("asset_id", "elem_order", anomaly.features().alias("f")).orderBy("elem_order").collect()
    for asset in ("a", "b", "c"):
        mine = [r for r in rows if r.asset_id == asset]
        want = forest_scores([r.f for r in mine], *shape)
        assert [got[r.elem_order] for r in mine] == pytest.approx(want)


@pytest.mark.parametrize("mode", ["windowed", "cumulative"])
def test_anomaly_batch_equals_brute_force(spark, data, monkeypatch, mode):
    """Windowed: uncapped mass over the reference rows; cumulative: mass capped at the window, over the window."""
    trees, depth, window, seed = 5, 4, 10, 9
    monkeypatch.setattr(anomaly, "SALT_ROWS", 20)  # several pieces per window
    near = data.withColumn("ts", F.col("ts") * 4)  # spread over a few days
    metrics = _metrics(near)
    got = {r.elem_order: r.anomaly_score for r in anomaly.score(metrics, trees, depth, window, seed, mode).collect()}
    rows = metrics.select("asset_id", "elem_order", (F.col("timestamp_ms") / 86_400_000).cast("int").alias("day"), anomaly.features().alias("f")).collect()
    dims, splits = anomaly.tree_arrays(trees, depth, seed)
    assert len({r.day for r in rows}) > 1
    for r in rows:
        ref = np.array([q.f for q in rows if q.asset_id == r.asset_id and q.day == r.day - 1])
        if not len(ref):
            assert got[r.elem_order] == 0.5
            continue
        lo, hi = ref.min(axis=0), ref.max(axis=0)

        def path(x, tree):
            node, seen = 0, []
            for _ in range(depth):
                seen.append(node)
                d = dims[tree, node]
                v = (x[d] - lo[d]) / (hi[d] - lo[d]) if hi[d] > lo[d] else 0.5
                node = 2 * node + (1 if v < splits[tree, node] else 2)
            return seen

        total = 0
        for t in range(trees):
            seen = [n for q in ref for n in path(q, t)]
            counts = [seen.count(n) for n in path(r.f, t)]
            total += sum(counts) if mode == "windowed" else sum(min(c, window) for c in counts)
        unit = len(ref) if mode == "windowed" else window
        assert got[r.elem_order] == pytest.approx(1 - total / (trees * depth * unit))
