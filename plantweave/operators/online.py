"""Score then update: each value is scored by the trees as the earlier values of its asset left them.

The rule reads row by row. An asset of at most a block of rows is replayed as it stands, one after the
other in time; the rows are shuffled once, as themselves. Of a longer asset the rows before can be summed:

1. The ranges before and after each row are running minima and maxima, so the nodes that the
   row asks and the nodes that it counts are known without any other row's score.
2. An asset's rows are cut into blocks of a fixed number of rows. A block's counts per last node
   are added up over the blocks before it; this sum is the state of the trees at the block's start.
3. Each (asset, block) replays its own rows behind its state and its range. Blocks are independent, so
   an asset with a third of all rows spreads over its blocks, and a task holds the masses of one block.

A state has at most ``trees * 2^depth`` numbers, and only assets of several blocks have any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantweave.operators import anomaly
from plantweave.operators.anomaly import DEPTH, FEATURES, SEED, TREES, WINDOW
from plantweave.operators.ordered import running_before, slice_width, spread
from plantweave.session import ensure_checkpoint_dir

#: Rows of an asset that are replayed one after the other.
BLOCK_ROWS = 20_000
#: Parts into which the nodes of an asset are dealt for the sums over its blocks.
_PARTS = 64
#: Rows whose nodes are held at once.
_SLICE_ROWS = 1024

_ORDER = ["timestamp_ms", "elem_order"]
_BLOCK = ["asset_id", "block"]


def _scaled(low: list[Column], high: list[Column]) -> Column:
    """Features on a range; 0.5 where that range is a point."""
    feature = [F.get("f", F.lit(i)) for i in range(FEATURES)]
    return F.array(*[
        F.when(b > a, F.try_divide(x - a, b - a)).otherwise(0.5) for x, a, b in zip(feature, low, high)
    ])


def _observed(metrics: DataFrame) -> DataFrame:
    """Rows that are scored, with their features."""
    return metrics.filter("value_num IS NOT NULL AND asset_id IS NOT NULL").select(
        "asset_id", "path", *_ORDER, "value_num", anomaly.features().alias("f")
    )


def _placed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows with their block and the number and range of the rows before each."""
    feature = [F.get("f", F.lit(i)) for i in range(FEATURES)]
    totals = {"before": ("count", F.lit(1))}
    totals |= {f"high{i}": ("max", x) for i, x in enumerate(feature)}
    totals |= {f"low{i}": ("max", -x) for i, x in enumerate(feature)}
    width = slice_width(rows, "timestamp_ms", block_rows)
    placed = running_before(rows, ["asset_id"], _ORDER, "timestamp_ms", totals, width)
    return placed.select(
        "asset_id", F.floor(F.col("before") / block_rows).cast("bigint").alias("block"), "path", *_ORDER, "value_num", "f",
        "before", F.array(*[-F.col(f"low{i}") for i in range(FEATURES)]).alias("low"),
        F.array(*[F.col(f"high{i}") for i in range(FEATURES)]).alias("high"),
    )


def _with_codes(placed: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """Placed rows with the last nodes that they count."""
    low, high, feature = ([F.get(c, F.lit(i)) for i in range(FEATURES)] for c in ("low", "high", "f"))
    counted = _scaled(
        [F.least(a, x) for a, x in zip(low, feature)], [F.greatest(b, x) for b, x in zip(high, feature)]
    )
    return placed.withColumn("counted", anomaly.leaf_codes(trees, depth, seed)(counted))


def _coded(metrics: DataFrame, trees: int, depth: int, seed: int, block_rows: int) -> DataFrame:
    """Rows with their block and the last nodes that they count."""
    return _with_codes(_placed(_observed(metrics), block_rows), trees, depth, seed)


def _states(coded: DataFrame) -> DataFrame:
    """Counts per last node at the start of each block but an asset's first."""
    counts = (
        coded.select(*_BLOCK, F.explode("counted").alias("code"))
        .groupBy(*_BLOCK, "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Assets of several blocks, once per part of the nodes, so that a long one does not meet in one task.
    several = (
        coded.groupBy("asset_id")
        .agg(F.max("block").alias("last"))
        .filter(F.col("last") > 0)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    )
    over = Window.partitionBy("asset_id", "part", "code").orderBy("block")
    sums = (
        counts.withColumn("part", F.pmod(F.col("code"), F.lit(_PARTS)))
        .join(several, ["asset_id", "part"])
        .select(
            *_BLOCK, "code", F.sum("n").over(over).alias("n"),
            F.coalesce(F.lead("block").over(over), F.col("last")).alias("until"),
        )
    )
    # A sum holds from the next block on, up to the block that counts into its node again.
    following = F.explode(F.sequence(F.col("block") + 1, F.col("until"))).alias("block")
    return (
        sums.filter(F.col("until") > F.col("block"))
        .select("asset_id", following, "code", "n")
        .groupBy(*_BLOCK)
        .agg(F.collect_list(F.struct("code", "n")).alias("state"))
    )


class Replay:
    """Trees of one asset, which score and then count rows in their order."""

    def __init__(self, trees: int, depth: int, window: int, seed: int):
        self.depth, self.window = depth, window
        self.dims, self.splits = anomaly.tree_arrays(trees, depth, seed)
        self.mass = np.zeros((trees, 1 << depth), dtype="int64")
        self.start()

    def start(self) -> None:
        """Forget all rows."""
        self.mass[:] = 0
        self.seen, self.low, self.high = 0, None, None

    def load(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Masses from the counts per last node."""
        self.mass[:] = 0
        self.mass.reshape(-1)[codes] = counts
        for level in range(self.depth - 2, -1, -1):
            below = self.mass[:, (2 << level) - 1 : (4 << level) - 1]
            self.mass[:, (1 << level) - 1 : (2 << level) - 1] = below.reshape(len(below), -1, 2).sum(axis=2)

    def last_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`load` reads: last nodes and their counts."""
        last = np.zeros_like(self.mass)
        at = slice((1 << self.depth - 1) - 1, (1 << self.depth) - 1)
        last[:, at] = self.mass[:, at]
        codes = np.flatnonzero(last)
        return codes, last.reshape(-1)[codes]

    def _codes(self, f: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        wide = high > low
        scaled = np.where(wide, (f - low) / np.where(wide, high - low, 1.0), 0.5)
        return anomaly.last_nodes(scaled, self.dims, self.splits, self.depth) + (np.arange(len(self.dims)) << self.depth)

    def run(self, f: np.ndarray) -> np.ndarray:
        """Total mass that each row finds; 0 for the first row of an asset, which asks nothing."""
        return np.concatenate([self._run(f[i : i + _SLICE_ROWS]) for i in range(0, len(f), _SLICE_ROWS)] or [np.zeros(0, "int64")])

    def _run(self, f: np.ndarray) -> np.ndarray:
        if self.low is None:
            self.low, self.high = f[0], f[0]
        low = np.minimum.accumulate(np.vstack([self.low[None, :], f]))
        high = np.maximum.accumulate(np.vstack([self.high[None, :], f]))
        counted = self._codes(f, low[1:], high[1:])
        # Only a row that widens the range asks other nodes than it counts.
        wider = ((low[1:] != low[:-1]) | (high[1:] != high[:-1])).any(axis=1)
        asked = counted
        if wider.any():
            asked = counted.copy()
            asked[wider] = self._codes(f[wider], low[:-1][wider], high[:-1][wider])
        counts = anomaly.path_codes(counted, self.depth).reshape(len(f), -1)
        asks = counts if asked is counted else anomaly.path_codes(asked, self.depth).reshape(len(f), -1)
        mass, total = self.mass.reshape(-1), np.zeros(len(f), dtype="int64")
        for i in range(len(f)):
            found = mass.take(asks[i])
            # No mass exceeds the number of rows before.
            total[i] = (found if self.seen + i <= self.window else np.minimum(found, self.window)).sum()
            mass[counts[i]] += 1  # a row passes a node once
        self.seen, self.low, self.high = self.seen + len(f), low[-1], high[-1]
        return total


def _numbers(column: pa.Array) -> np.ndarray:
    """A list column's values, one row per list."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_FOUND = "asset_id string, path string, timestamp_ms bigint, elem_order string, value_num double, observations bigint, total_mass bigint"


def _replayed(lines: DataFrame, group: list[str], shape: tuple[int, int, int, int]) -> DataFrame:
    """Total mass of each row. A group's rows come in their order, behind its state if it has one."""
    has_state = "role" in lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, key = Replay(*shape), None
        for batch in batches:
            if not batch.num_rows:
                continue
            total, seen = np.zeros(batch.num_rows, dtype="int64"), np.zeros(batch.num_rows, dtype="int64")
            keys = [batch.column(c) for c in group]
            new = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in keys:
                new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            is_row = np.ones(batch.num_rows, dtype=bool)
            if has_state:
                is_row = batch.column("role").to_numpy() == 1
            for begin, end in zip(cuts, cuts[1:]):
                at = [c[begin].as_py() for c in keys]
                if at != key:
                    key = at
                    trees.start()
                while begin < end and not is_row[begin]:
                    trees.load(np.array(batch.column("codes")[begin].as_py()), np.array(batch.column("counts")[begin].as_py()))
                    begin += 1
                if begin == end:
                    continue
                if has_state and trees.low is None and batch.column("before")[begin].as_py():
                    # The first row of a later block brings the range and number of all rows before.
                    trees.low, trees.high = (np.array(batch.column(c)[begin].as_py()) for c in ("low", "high"))
                    trees.seen = batch.column("before")[begin].as_py()
                seen[begin:end] = trees.seen + np.arange(1, end - begin + 1)
                total[begin:end] = trees.run(_numbers(batch.column("f")[begin:end]))
            out = [batch.column(c) for c in ("asset_id", "path", *_ORDER, "value_num")] + [pa.array(seen), pa.array(total)]
            yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _FOUND.split(", ")]).filter(pa.array(is_row))

    return lines.mapInArrow(run, _FOUND)


def score_then_update(
    metrics: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    window: int = WINDOW,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Anomaly score of every numeric value against all earlier values of its asset.

    Same rows as the stream of the same rule: a node's mass is at most ``window``, the first value of
    an asset scores 0.5. ``observations`` counts the value itself. (timestamp_ms, elem_order) must be
    unique in an asset and values finite; rows without an asset or a numeric value are left out.
    Only assets of several blocks are coded, placed and checkpointed, as the sums and the replay both read them.
    """
    ensure_checkpoint_dir(metrics.sparkSession)
    shape, rows = (trees, depth, window, seed), _observed(metrics)
    # At most one per block of rows.
    several = rows.groupBy("asset_id").count().filter(F.col("count") > block_rows).select("asset_id").checkpoint()
    short = spread(rows.join(F.broadcast(several), "asset_id", "left_anti"), "asset_id").sortWithinPartitions("asset_id", *_ORDER)
    found = _replayed(short, ["asset_id"], shape)
    if not several.isEmpty():
        placed = _placed(rows.join(F.broadcast(several), "asset_id", "left_semi"), block_rows).checkpoint()
        states = _states(_with_codes(placed, trees, depth, seed)).select(
            *_BLOCK, F.col("state.code").alias("codes"), F.col("state.n").alias("counts"), F.lit(0).alias("role")
        )
        lines = placed.withColumn("role", F.lit(1)).unionByName(states, True)
        lines = spread(lines, *_BLOCK).sortWithinPartitions(*_BLOCK, "role", *_ORDER)
        found = found.unionByName(_replayed(lines, _BLOCK, shape))
    value = F.lit(1.0) - F.col("total_mass") / F.lit(trees * depth * window)
    return found.select(
        "asset_id", "path", *_ORDER, "value_num", "observations",
        F.when(F.col("observations") > 1, value).otherwise(0.5).alias("anomaly_score"),
    )
