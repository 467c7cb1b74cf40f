"""Greedy cooldown: emit a row only if enough time passed since the last emitted one.

The rule is sequential, but a slice of the time line can be summarised on its own, as a step
function from the earliest instant that may emit at its start to the one after its end. The
emission before a slice lies outside it, so the slice's first emission is one of its times
within the first cooldown, or the first time after that: the steps are few. Functions of
neighbouring slices compose to a function of the same kind. So, with streams over sorted rows:

1. per (key, slice): the function of the slice;
2. up a tree: per (key, ``RADIX`` neighbours) their composition, ``LEVELS`` times;
3. down the tree: per (key, group) the earliest instant of each member, from the group's own;
4. per (key, slice): the emissions from that instant on.

No array of a key's times is built, and no task reads all slices of a key: a function has at
most the distinct instants of one cooldown as steps, a task of passes 2 and 3 reads ``RADIX``
of them per group, and the top one per ``RADIX ** LEVELS`` slices of ``SLICE`` cooldowns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.operators.ordered import HOUR_MS, spread, time_slice

#: Cooldowns per slice, neighbours that are composed to one function, and how often.
SLICE, RADIX, LEVELS = 12, 64, 2
#: Before all times.
_EVER = -(1 << 62)


def _groups(pdf: pd.DataFrame, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key values, first row, end) of each run of equal keys in a sorted batch."""
    if not len(pdf):
        return
    values = [pdf[c].to_numpy() for c in columns]
    new = np.zeros(len(pdf), dtype=bool)
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    new[0] = True
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(pdf))):
        yield tuple(v[a] for v in values), int(a), int(b)


def _advance(times: np.ndarray, last: np.ndarray, cooldown: int) -> np.ndarray:
    """The last emission of each chain once these times are read as well."""
    while True:
        hop = np.searchsorted(times, last + cooldown, side="left")
        go = hop < len(times)
        if not go.any():
            return last
        last = np.where(go, times[np.minimum(hop, len(times) - 1)], last)


class _Chains:
    """The chains of one slice: its possible first emissions and where each has come to."""

    def __init__(self, start: int, cooldown: int):
        self.limit, self.cooldown, self.complete = start + cooldown, cooldown, False
        self.entries = self.chain = self.last = np.zeros(0, dtype="int64")

    def read(self, times: np.ndarray) -> None:
        last = self.last[self.chain]
        if not self.complete:
            inside = int(np.searchsorted(times, self.limit, side="left"))
            self.complete = inside < len(times)
            new = np.unique(times[: inside + 1])
            new = new[~np.isin(new, self.entries[-1:])]
            self.entries, last = np.append(self.entries, new), np.append(last, new)
        # Chains that have met go on as one.
        merged, self.chain = np.unique(last, return_inverse=True)
        self.last = _advance(times, merged, self.cooldown)

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries and the earliest instants after; of a run of equal ones the largest entry stands for all."""
        after = self.last[self.chain] + self.cooldown
        keep = np.append(after[1:] != after[:-1], True)
        return self.entries[keep], after[keep]


def _frame(columns: list[str], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def _chain_ends(keys: list[str], cooldown: int) -> Callable:
    group, columns = [*keys, "_slice"], [*keys, "_slice", "_entry", "_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, chains = None, None
        for pdf in batches:
            times, rows = pdf["_ts"].to_numpy(), []
            for key, a, b in _groups(pdf, group):
                if key != open_key:
                    if chains is not None:
                        rows += [(*open_key, e, x) for e, x in zip(*chains.steps())]
                    open_key, chains = key, _Chains(int(key[-1]), cooldown)
                chains.read(times[a:b])
            yield _frame(columns, rows)
        if chains is not None:
            yield _frame(columns, [(*open_key, e, x) for e, x in zip(*chains.steps())])

    return run


class _Steps:
    """A function of the earliest instant: the value of the first entry not before it, or itself."""

    def __init__(self) -> None:
        self.entries = self.values = np.zeros(0, dtype="int64")

    def then(self, entries: np.ndarray, values: np.ndarray, limit: int) -> None:
        """Go on with a later slice's function; instants from ``limit`` on are never asked."""
        at = np.searchsorted(entries, self.values, side="left")
        mapped = np.where(at < len(entries), values[np.minimum(at, len(entries) - 1)], self.values)
        later = entries > self.entries[-1] if len(self.entries) else np.ones(len(entries), dtype=bool)
        entries, values = np.append(self.entries, entries[later]), np.append(mapped, values[later])
        keep = np.append(values[1:] != values[:-1], True)  # the last entry of a run stands for it
        entries, values = entries[keep], values[keep]
        end = int(np.searchsorted(entries, limit, side="left")) + 1
        self.entries, self.values = entries[:end], values[:end]


def _composed(keys: list[str], cooldown: int) -> Callable:
    """Function of each parent from those of its slices."""
    group, columns = [*keys, "_parent", "_slice"], [*keys, "_slice", "_entry", "_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, steps, parts = None, _Steps(), []

        def close_slice() -> None:
            if parts:
                entries, values = (np.concatenate(c) for c in zip(*parts))
                steps.then(entries, values, int(open_key[-2]) + cooldown)
                parts.clear()

        def parent_rows() -> list[tuple]:
            return [(*open_key[:-1], e, x) for e, x in zip(steps.entries, steps.values)]

        for pdf in batches:
            entries, values, rows = pdf["_entry"].to_numpy(), pdf["_next"].to_numpy(), []
            for key, a, b in _groups(pdf, group):
                if key != open_key:
                    close_slice()
                    if open_key is not None and key[:-1] != open_key[:-1]:
                        rows += parent_rows()
                        steps = _Steps()
                    open_key = key
                parts.append((entries[a:b], values[a:b]))
            yield _frame(columns, rows)
        if open_key is not None:
            close_slice()
            yield _frame(columns, parent_rows())

    return run


def _slice_starts(keys: list[str]) -> Callable:
    """Earliest instant of each slice of a parent, whose own is ``_start``."""
    group, columns = [*keys, "_parent", "_slice"], [*keys, "_slice", "_earliest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, earliest, found = None, None, False
        for pdf in batches:
            entries, values, rows = pdf["_entry"].to_numpy(), pdf["_next"].to_numpy(), []
            starts = pdf["_start"].to_numpy()
            for key, a, b in _groups(pdf, group):
                if key != open_key:
                    if open_key is None or key[:-1] != open_key[:-1]:
                        earliest = int(starts[a])
                    open_key, found = key, False
                    rows.append((*key[:-2], key[-1], earliest))
                if not found:
                    i = a + int(np.searchsorted(entries[a:b], earliest, side="left"))
                    if i < b:
                        earliest, found = int(values[i]), True
            yield _frame(columns, rows)

    return run


def _emissions(keys: list[str], ts: str, cooldown: int) -> Callable:
    group, columns = [*keys, "_slice"], [*keys, ts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, earliest = None, 0
        for pdf in batches:
            times, starts, rows = pdf["_ts"].to_numpy(), pdf["_earliest"].to_numpy(), []
            for key, a, b in _groups(pdf, group):
                if key != open_key:  # the row in front tells where the slice begins
                    open_key, earliest, a = key, int(starts[a]), a + 1
                while (i := a + int(np.searchsorted(times[a:b], earliest, side="left"))) < b:
                    rows.append((*key[:-1], int(times[i])))
                    a, earliest = i + 1, int(times[i]) + cooldown
            yield _frame(columns, rows)

    return run


def _named(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)


def _levels(rows: DataFrame, keys: list[str], cooldown: int, width: int) -> list[DataFrame]:
    """Functions of slices, of groups of them, and so on, each dealt out by its parent.

    Going up and down read a level from the same exchange, so no function is found twice.
    """
    schema = f"{_named(rows, keys)}, _slice bigint, _entry bigint, _next bigint"
    group = [*keys, "_slice"]
    steps = spread(rows, *group).sortWithinPartitions(*group, "_ts").mapInPandas(_chain_ends(keys, cooldown), schema)
    levels = []
    for level in range(1, LEVELS + 1):
        parent = time_slice(F.col("_slice"), width * RADIX**level)
        levels.append(steps.withColumn("_parent", parent).repartition(*keys, "_parent"))
        steps = (
            levels[-1]
            .sortWithinPartitions(*keys, "_parent", "_slice", "_entry")
            .mapInPandas(_composed(keys, cooldown), schema)
        )
    levels.append(steps.withColumn("_parent", F.lit(0).cast("bigint")).repartition(*keys, "_parent"))
    return levels


def cooldown_times(
    df: DataFrame, keys: list[str], ts: str, cooldown_ms: int, slice_ms: int | None = None
) -> DataFrame:
    """The emitted (key, ts) pairs; rows without a key or time are left out."""
    width = slice_ms or max(cooldown_ms * SLICE, HOUR_MS)
    rows = df.select(*keys, F.col(ts).cast("bigint").alias("_ts")).dropna()
    rows = rows.withColumn("_slice", time_slice(F.col("_ts"), width))
    named = _named(df, keys)
    group = [*keys, "_slice"]
    levels = _levels(rows, keys, cooldown_ms, width)
    starts = None
    for steps in reversed(levels):
        if starts is None:
            known = steps.withColumn("_start", F.lit(_EVER))
        else:
            above = starts.select(*keys, F.col("_slice").alias("_parent"), F.col("_earliest").alias("_start"))
            # Each row has its parent; an inner join would filter nulls below the exchange, which then is another one.
            known = steps.join(above, [*keys, "_parent"], "left")
        starts = known.sortWithinPartitions(*keys, "_parent", "_slice", "_entry").mapInPandas(
            _slice_starts(keys), f"{named}, _slice bigint, _earliest bigint"
        )
    # A slice's start is sorted in front of its rows.
    first = starts.select(*group, F.lit(0).alias("_role"), F.lit(0).cast("bigint").alias("_ts"), "_earliest")
    rest = rows.select(*group, F.lit(1).alias("_role"), "_ts", F.lit(0).cast("bigint").alias("_earliest"))
    return (
        spread(first.unionByName(rest), *group)
        .sortWithinPartitions(*group, "_role", "_ts")
        .mapInPandas(_emissions(keys, ts, cooldown_ms), f"{named}, `{ts}` bigint")
    )


def cooldown(
    df: DataFrame, keys: list[str], ts: str, order: list[str], cooldown_ms: int
) -> DataFrame:
    """The rows that are emitted; of rows at one instant the first by ``order``."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    first = df.groupBy(*keys, ts).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    times = cooldown_times(df, keys, ts, cooldown_ms)
    return first.join(times, [*keys, ts], "left_semi").select(*keys, ts, "_row.*").select(*df.columns)
