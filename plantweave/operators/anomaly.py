"""Value anomalies by half-space trees.

Batch form: per asset the rows of one day are the reference window for the next
day's rows, so windows are independent and run in parallel. The streaming form in
``plantweave.streaming.processors`` scores and updates row by row instead, and so does
``plantweave.operators.online`` in batch.

A row's path through a tree is fixed by the last node on it. So the reference rows are
counted per last node, which is at most ``trees * 2^(depth-1)`` numbers per window
however many rows it has. Each window's ranges, reference rows and rows to score are sorted
behind one another and read as a stream: a row is shuffled as itself, never as its nodes, and
no window is held whole. Only days with very many rows of an asset are counted before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantweave.functions import scoring
from plantweave.functions.json import json_object, or_null, quoted
from plantweave.operators.fidelity import path_depth
from plantweave.operators.mapping import alert_topic
from plantweave.operators.ordered import spread, top_per_key
from plantweave.operators.throttle import cooldown
from plantweave.session import shared_folder

TREES, DEPTH, WINDOW, SEED = 25, 10, 1000, 42
FEATURES = 5
DAY_MS = 86_400_000


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def features() -> Column:
    """Five numbers describing a metric observation."""
    filled = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").cast("double")
    return F.array(
        F.coalesce(F.col("value_num"), F.lit(0.0)),
        (_hex(F.substring(F.md5("value_type"), 1, 8)) % 1000) / F.lit(1000.0),
        F.least(path_depth(F.col("path")) / F.lit(10.0), F.lit(1.0)),
        filled("semantic_id"),
        filled("unit"),
    )


def tree_nodes(
    spark: SparkSession, trees: int = TREES, depth: int = DEPTH, seed: int = SEED
) -> DataFrame:
    """Inner nodes of all trees: (tree, node, dim, split), drawn from a seeded hash."""
    inner = (1 << depth) - 1
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("tree"), F.col("node")))
    return (
        spark.range(trees * inner)
        .select((F.col("id") / inner).cast("int").alias("tree"), (F.col("id") % inner).cast("int").alias("node"))
        .select(
            "tree",
            "node",
            (_hex(F.substring(digest, 1, 8)) % FEATURES).cast("int").alias("dim"),
            (_hex(F.substring(digest, 9, 8)) / F.lit(4294967296.0)).alias("split"),
        )
    )


def tree_arrays(trees: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`tree_nodes` as (dims, splits), one row per tree."""
    inner = (1 << depth) - 1
    digests = [
        hashlib.md5(f"{seed}:{t}:{n}".encode()).hexdigest() for t in range(trees) for n in range(inner)
    ]
    dims = np.array([int(d[:8], 16) % FEATURES for d in digests]).reshape(trees, inner)
    splits = np.array([int(d[8:16], 16) / 4294967296.0 for d in digests]).reshape(trees, inner)
    return dims, splits


def last_nodes(x: np.ndarray, dims: np.ndarray, splits: np.ndarray, depth: int) -> np.ndarray:
    """Last node per row and tree for scaled features ``x``."""
    rows = np.arange(len(x))[:, None]
    tree = np.arange(len(dims))[None, :]
    node = np.zeros((len(x), len(dims)), dtype="int64")
    for _ in range(depth - 1):
        right = np.where(x[rows, dims[tree, node]] < splits[tree, node], 1, 2)
        node = 2 * node + right
    return node


def leaf_codes(trees: int, depth: int, seed: int):
    """Arrow function: scaled features to one code ``tree * 2^depth + last node`` per tree."""
    dims, splits = tree_arrays(trees, depth, seed)
    offset = np.arange(trees) << depth

    @F.pandas_udf("array<int>")
    def codes(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        out = np.full(len(x), None, dtype=object)
        if known.any():
            found = last_nodes(np.stack(x[known].to_numpy()), dims, splits, depth) + offset
            for i, row in zip(np.flatnonzero(known), found.astype("int32")):
                out[i] = row
        return pd.Series(out, index=x.index)

    return codes


def path_codes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Codes of all nodes on the path to each code, in a new last axis."""
    tree, node = codes >> depth, codes & ((1 << depth) - 1)
    up = np.arange(depth)
    return (tree[..., None] << depth) + ((node[..., None] + 1) >> up) - 1


def _windows(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their features and day, per reference window its row count and ranges)."""
    day = F.floor(F.col("timestamp_ms") / DAY_MS).cast("bigint")
    rows = metrics.filter(F.col("value_num").isNotNull()).select(
        "asset_id", "path", "timestamp_ms", "elem_order", "value_num",
        day.alias("day"), features().alias("f"),
    )
    at = lambda i: F.get("f", F.lit(i))
    ranges = rows.groupBy("asset_id", (F.col("day") + 1).alias("window")).agg(
        F.count(F.lit(1)).alias("reference_rows"),
        F.array(*[F.min(at(i)) for i in range(FEATURES)]).alias("lo"),
        F.array(*[F.max(at(i)) for i in range(FEATURES)]).alias("hi"),
    )
    return rows, ranges


def _scaled() -> Column:
    """Features on the reference range; 0.5 where that range is a point."""
    return F.array(
        *[
            F.when(F.get("hi", F.lit(i)) == F.get("lo", F.lit(i)), 0.5).otherwise(
                F.try_divide(
                    F.get("f", F.lit(i)) - F.get("lo", F.lit(i)),
                    F.get("hi", F.lit(i)) - F.get("lo", F.lit(i)),
                )
            )
            for i in range(FEATURES)
        ]
    )


_KEYS = ["asset_id", "window"]
_GROUP = [*_KEYS, "piece"]
#: What a row is to its window, in the order of reading.
_RANGE, _COUNTS, _REFERENCE, _OBSERVED = range(4)
#: A day with more rows of an asset is scored in pieces and counted before the windows are read.
SALT_ROWS = 200_000
#: Rows of a batch that are worked on at once.
_SLICE_ROWS = 4096


def _leaf_counts(rows: DataFrame, ranges: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """Reference rows per window and last node."""
    codes = leaf_codes(trees, depth, seed)
    return (
        rows.join(ranges, _KEYS)
        .select(*_KEYS, F.explode(codes(_scaled())).alias("code"))
        .groupBy(*_KEYS, "code")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*_KEYS)
        .agg(F.collect_list(F.struct("code", "n")).alias("s"))
        .select(*_KEYS, F.col("s.code").alias("codes"), F.col("s.n").alias("counts"))
    )


def _lined_up(metrics: DataFrame, trees: int, depth: int, seed: int, observed: bool) -> DataFrame:
    """Each window's ranges and reference rows, and behind them the rows to score.

    A window is one group of a task. Where the reference day is large, its rows are counted per last
    node first and their counts take their place; where the day to score is large, it is dealt
    out to pieces with the same counts each.
    """
    rows, ranges = _windows(metrics)
    reference = rows.select("asset_id", (F.col("day") + 1).alias("window"), "f").filter("asset_id IS NOT NULL AND window IS NOT NULL")
    # At most one per SALT_ROWS rows.
    large = (
        rows.groupBy("asset_id", "day").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SALT_ROWS)
        .select("asset_id", "day", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("pieces"))
    )
    pieces = large.withColumnRenamed("day", "window")
    counted = large.select("asset_id", (F.col("day") + 1).alias("window"))
    if observed:
        counted = counted.union(pieces.select(*_KEYS)).distinct()
    counts = _leaf_counts(reference.join(F.broadcast(counted), _KEYS, "left_semi"), ranges, trees, depth, seed)
    plain = reference.join(F.broadcast(counted), _KEYS, "left_anti").withColumn("role", F.lit(_REFERENCE))
    heads = counts.withColumn("role", F.lit(_COUNTS)).unionByName(
        ranges.filter("asset_id IS NOT NULL AND window IS NOT NULL").withColumn("role", F.lit(_RANGE)), True
    )
    if observed:
        each = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
        heads = heads.join(F.broadcast(pieces), _KEYS, "left").withColumn("piece", F.explode(each)).drop("pieces")
        piece = F.pmod(F.xxhash64("elem_order"), F.coalesce("pieces", F.lit(1))).cast("int")
        asked = (
            rows.withColumnRenamed("day", "window").join(F.broadcast(pieces), _KEYS, "left")
            .withColumn("piece", piece).withColumn("role", F.lit(_OBSERVED)).drop("pieces")
        )
        lines = heads.unionByName(plain.withColumn("piece", F.lit(0)), True).unionByName(asked, True)
    else:
        lines = heads.unionByName(plain, True).withColumn("piece", F.lit(0))
    return spread(lines, *_GROUP).sortWithinPartitions(*_GROUP, "role")


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows; NaN for null."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _levels(key: np.ndarray, count: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(steps up, sorted nodes, their rows) from sorted last nodes; nodes of a level keep their order on the way up."""
    for up in range(depth):
        node = _above(key, up, depth)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, "int64")
        yield up, node[first], np.add.reduceat(count, first) if len(first) else count


def _above(key: np.ndarray, up: int, depth: int) -> np.ndarray:
    """Node ``up`` steps above each last node; keys hold window and tree in their upper bits."""
    low = key & ((1 << depth) - 1)
    return key - low + ((low + 1) >> up) - 1


class _Slices:
    """Reads sorted lines of windows; knows the ranges and counts of the window it is in.

    After :meth:`read` a slice's windows are numbered, 0 being the one that was open before; ``key`` and
    ``count`` are their last nodes, sorted, and how many reference rows end there.
    """

    def __init__(self, trees: int, depth: int, seed: int):
        self.dims, self.splits = tree_arrays(trees, depth, seed)
        self.trees, self.depth, self.span = trees, depth, trees << depth
        self.name, self.range = None, np.full(2 * FEATURES + 1, np.nan)
        self.key = self.count = np.zeros(0, "int64")
        self.number = np.zeros(1, "int64")

    def read(self, lines: pa.RecordBatch) -> None:
        mine = self.key // self.span == self.number[-1]
        owners, codes, counts = [np.zeros(mine.sum(), "int64")], [self.key[mine] % self.span], [self.count[mine]]
        opened = self.range[self.number[-1]] if self.range.ndim == 2 else self.range
        self.before, self.names = self.name, lines.select(_KEYS)
        new = np.zeros(len(lines), dtype=bool)
        for name in _GROUP:
            column = lines.column(name)
            other = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True)
            new[1:] |= other.to_numpy(zero_copy_only=False)
        new[0] = self.name != tuple(lines.column(c)[0].as_py() for c in _GROUP)
        self.name = tuple(lines.column(c)[-1].as_py() for c in _GROUP)
        self.first, self.number, role = np.flatnonzero(new), np.cumsum(new), lines.column("role").to_numpy()
        self.range = np.full((self.number[-1] + 1, 2 * FEATURES + 1), np.nan)
        self.range[0] = opened
        heads = lines.filter(pa.array(role == _RANGE))
        if len(heads):
            lo, hi = _matrix(heads.column("lo")), _matrix(heads.column("hi"))
            # A feature that is null in the whole window has no range, which is not a point either.
            hi[heads.column("lo").flatten().is_null().to_numpy(zero_copy_only=False).reshape(lo.shape)] = 0.0
            self.range[self.number[role == _RANGE]] = np.column_stack([lo, hi, heads.column("reference_rows").to_numpy()])
        state = lines.filter(pa.array(role == _COUNTS))
        owners.append(np.repeat(self.number[role == _COUNTS], pc.list_value_length(state.column("codes")).to_numpy()))
        codes.append(state.column("codes").flatten().to_numpy().astype("int64"))
        counts.append(state.column("counts").flatten().to_numpy())
        found = self.last(lines, role == _REFERENCE)
        owners.append(np.zeros(found.size, "int64"))
        codes.append(found.ravel())
        counts.append(np.ones(found.size, "int64"))
        key = np.concatenate(owners) * self.span + np.concatenate(codes)
        order = np.argsort(key, kind="stable")
        _, self.key, self.count = next(_levels(key[order], np.concatenate(counts)[order], self.depth))

    def last(self, lines: pa.RecordBatch, wanted: np.ndarray) -> np.ndarray:
        """Keys of the last nodes of the wanted rows, per tree."""
        number = self.number[wanted]
        lo, hi = self.range[number, :FEATURES], self.range[number, FEATURES:-1]
        f = _matrix(lines.filter(pa.array(wanted)).column("f")) if len(number) else lo
        point = (hi == lo) | (np.isnan(hi) & np.isnan(lo))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            x = np.where(point, 0.5, (f - lo) / (hi - lo))
        node = last_nodes(x, self.dims, self.splits, self.depth)
        return number[:, None] * self.span + (np.arange(self.trees) << self.depth) + node

    def known(self) -> np.ndarray:
        """Reference rows per window; 0 without a reference."""
        return np.nan_to_num(self.range[:, -1]).astype("int64")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _SLICE_ROWS):
            yield batch.slice(at, _SLICE_ROWS)


def _tree_masses(metrics: DataFrame, trees: int, depth: int, window: int, seed: int, summed: bool) -> DataFrame:
    """Per reference window and tree the nodes that its rows pass through and their mass: arrays, or sums over them."""

    out = {"nodes": "bigint", "mass": "bigint", "weighted": "bigint"} if summed else {"node": "array<int>", "mass": "array<bigint>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _Slices(trees, depth, seed)

        def masses(closed: np.ndarray, names: pa.RecordBatch) -> pa.RecordBatch:
            levels = [(node, mass) for _, node, mass in _levels(slices.key[closed], slices.count[closed], depth)]
            node, mass = (np.concatenate(c) for c in zip(*levels))
            order = np.argsort(node, kind="stable")
            node, mass = node[order], np.minimum(mass[order], window)
            tree = node >> depth
            first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1])) if len(tree) else np.zeros(0, "int64")
            ends, inner = np.append(first, len(tree)), node & ((1 << depth) - 1)
            if summed:
                total = lambda x: pa.array(np.add.reduceat(x, first) if len(first) else x)
                found = [pa.array(np.diff(ends)), total(mass), total(mass * inner)]
            else:
                listed = lambda x: pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(x))
                found = [listed(inner.astype("int32")), listed(mass)]
            keys = names.take(pa.array(node[first] // slices.span)).columns
            columns = [*keys, pa.array((tree[first] % trees).astype("int32")), *found]
            return pa.RecordBatch.from_arrays(columns, names=[*_KEYS, "tree", *out])

        for lines in _cut(batches):
            slices.read(lines)
            before = slices.before or (None,) * len(_KEYS)
            opened = [pa.array([v], c.type) for v, c in zip(before, slices.names.columns)]
            numbered = [pa.concat_arrays([o, c.take(pa.array(slices.first))]) for o, c in zip(opened, slices.names.columns)]
            names = pa.RecordBatch.from_arrays(numbered, names=_KEYS)
            yield masses(slices.key // slices.span < slices.number[-1], names)
        if slices.name is not None:
            yield masses(slices.key // slices.span == slices.number[-1], names)

    return _lined_up(metrics, trees, depth, seed, observed=False).mapInArrow(
        run, "asset_id string, window bigint, tree int, " + ", ".join(f"{c} {t}" for c, t in out.items())
    )


def reference_mass(
    metrics: DataFrame, trees: int = TREES, depth: int = DEPTH, window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """Mass of every node that a reference window's rows pass through."""
    found = _tree_masses(metrics, trees, depth, window, seed, summed=False)
    return found.select(*_KEYS, "tree", F.inline(F.arrays_zip("node", "mass")))


def tree_totals(
    metrics: DataFrame, trees: int = TREES, depth: int = DEPTH, window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """:func:`reference_mass` per tree: how many nodes, their mass, and their mass times their number."""
    return _tree_masses(metrics, trees, depth, window, seed, summed=True)


def score(
    metrics: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    window: int = WINDOW,
    seed: int = SEED,
    mode: str = "windowed",
) -> DataFrame:
    """Anomaly score of every numeric observation against the day before.

    ``windowed`` divides the mass by the reference rows, ``cumulative`` caps it at the window
    size and divides by that. An observation without a reference window scores 0.5.
    """
    cap = window if mode == "cumulative" else None
    columns = ["asset_id", "path", "timestamp_ms", "elem_order", "value_num"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _Slices(trees, depth, seed)
        for lines in _cut(batches):
            slices.read(lines)
            wanted = lines.column("role").to_numpy() == _OBSERVED
            asked, total = slices.last(lines, wanted), np.zeros(wanted.sum(), "int64")
            for up, node, mass in _levels(slices.key, slices.count, depth):
                ask = _above(asked, up, depth)
                at = np.minimum(np.searchsorted(node, ask), max(len(node) - 1, 0))
                if len(node):
                    mass = mass if cap is None else np.minimum(mass, cap)
                    total += np.where(node[at] == ask, mass[at], 0).sum(axis=1)
            rows = lines.filter(pa.array(wanted)).select(columns)
            seen = pa.array(slices.known()[slices.number[wanted]])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, seen, pa.array(total)], names=[*columns, "observations", "total_mass"]
            )

    totals = _lined_up(metrics, trees, depth, seed, observed=True).mapInArrow(
        run,
        "asset_id string, path string, timestamp_ms bigint, elem_order string, value_num double, "
        "observations bigint, total_mass bigint",
    )
    unit = F.lit(window) if mode == "cumulative" else F.col("observations")
    value = F.lit(1.0) - F.col("total_mass") / (unit * (trees * depth))
    scored = F.when(F.col("observations") > 0, value).otherwise(0.5)
    return totals.select(*columns, "observations", scored.alias("anomaly_score"))


def classify(
    scores: DataFrame, window: int = WINDOW, thresholds: dict[str, float] | None = None
) -> DataFrame:
    """Drift flag, severity, confidence and suggested action of scored observations."""
    t = thresholds or scoring.SEVERITY_THRESHOLDS
    value = F.col("anomaly_score")
    is_drift = value >= t["low"]
    level = F.when(is_drift, scoring.severity(value, t)).otherwise("low")
    conf = scoring.confidence(value, F.col("observations"), window)
    advice = F.when(is_drift, scoring.action(F.lit("value_anomaly"), level, conf)).otherwise("none")
    return scores.select(
        "asset_id", "path", "timestamp_ms", "elem_order",
        is_drift.alias("is_drift"),
        F.lit("value_anomaly").alias("drift_type"),
        level.alias("severity"),
        conf.alias("confidence"),
        "anomaly_score",
        advice.alias("suggested_action"),
        F.when(is_drift, F.create_map(
            F.lit("value"), F.col("value_num").cast("string"),
            F.lit("observationCount"), F.col("observations").cast("string"),
        )).alias("details"),
    )


RESULT = [
    "asset_id", "timestamp_ms", "drift_type", "severity", "confidence",
    "anomaly_score", "suggested_action", "path",
]


def detect_batch(metrics: DataFrame, schema_results: DataFrame, **options) -> DataFrame:
    """Schema drift and value drift results together, drifts only."""
    values = classify(score(metrics, **options)).filter("is_drift").select(*RESULT)
    return schema_results.select(*RESULT[:-1], F.lit("").alias("path")).unionByName(values)


def observation_estimate(
    totals: DataFrame, ranges: DataFrame, trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """Mean over trees of floor(mass / nodes) of :func:`tree_totals`, next to the true reference row count."""
    nodes = (1 << (depth + 1)) - 1
    per_tree = F.floor(F.col("mass") / nodes).cast("bigint")
    estimate = totals.groupBy("asset_id", "window").agg(
        F.floor(F.sum(per_tree) / trees).cast("bigint").alias("estimate")
    )
    return estimate.join(
        ranges.select("asset_id", "window", "reference_rows"), ["asset_id", "window"]
    )


def reference_windows(metrics: DataFrame) -> DataFrame:
    return _windows(metrics)[1]


def history(results: DataFrame, n: int) -> DataFrame:
    """Latest ``n`` drift results per asset."""
    return top_per_key(results, ["asset_id"], [F.col("timestamp_ms").desc(), F.col("path")], n)


def severe_alerts(
    results: DataFrame, cooldown_ms: int = 300_000, prefix: str = "UNS/Sys/StreamingDriftAlerts"
) -> DataFrame:
    """High and critical results, at most one per asset and cooldown.

    They are written to the shared folder first: the cooldown reads its rows several times, and each
    time would score all rows again.
    """
    stored = shared_folder(results.sparkSession, "severe")
    results.filter(F.col("severity").isin("high", "critical")).write.parquet(stored)
    severe = results.sparkSession.read.parquet(stored)
    kept = cooldown(severe, ["asset_id"], "timestamp_ms", ["path"], cooldown_ms)
    payload = json_object(
        ("isDrift", F.lit("true")),
        ("driftType", quoted(F.col("drift_type"))),
        ("severity", quoted(F.col("severity"))),
        ("confidence", F.col("confidence")),
        ("anomalyScore", F.col("anomaly_score")),
        ("suggestedAction", quoted(F.col("suggested_action"))),
        ("metricPath", or_null(quoted(F.col("path")))),
    )
    topic = alert_topic(prefix, F.col("asset_id"), 64, colons=True)
    return kept.select(*results.columns, topic.alias("topic"), payload.alias("payload"))


def result_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("drift_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def last_scores(results: DataFrame) -> DataFrame:
    return results.groupBy("asset_id").agg(
        F.max_by("anomaly_score", F.struct("timestamp_ms", "path")).alias("last_score")
    )
