"""Per-key state machines for ``transformWithStateInPandas``.

Each takes the rows of one key in a micro-batch, whose size the source's rate limit
bounds, in event-time order. They give the same rows as the batch operators.

A call of a processor costs milliseconds, whatever its rows. Where keys are many and a key's
work is small, a call takes the keys of one bucket and the state is a map from key to entry.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plantweave.operators import anomaly, dedup, online

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024


def _ordered(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


def _columns(rows: Iterator[pd.DataFrame], ts: str, order: str, *rest: str) -> list[np.ndarray]:
    """Columns of a key's rows in their order; without a data frame's sort, which costs more than a short key's work."""
    parts = list(rows)
    columns = [np.concatenate([p[c].to_numpy() for p in parts]) for c in (ts, order, *rest)]
    place = sorted(range(len(columns[0])), key=list(zip(columns[0].tolist(), columns[1].tolist())).__getitem__)
    return [c[place] for c in columns]


class Cooldown(StatefulProcessor):
    """Emit a row if enough time passed since the last emitted one."""

    def __init__(self, cooldown_ms: int):
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, "ts", "ord")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for ts in pdf["ts"].to_numpy():
            emit = last is None or ts - last >= self.cooldown_ms
            keep.append(emit)
            last = int(ts) if emit else last
        self.last.update((last,))
        yield pdf[keep][["k", "ts", "ord"]]

    def close(self) -> None:
        pass


class Changed(StatefulProcessor):
    """Emit a row if its value hash differs from the stored one or the entry expired; takes a bucket of keys."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "k string", "hash string, created_at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, "k", "ts", "ord")
        known = self.entries.exists()  # a bucket's first batch asks for no entry
        keep = []
        for k, mine in groupby(zip(pdf["k"], pdf["ts"].tolist(), pdf["hash"]), itemgetter(0)):
            stored, created = (known and self.entries.getValue((k,))) or (None, None)
            for _, ts, digest in mine:
                if created is None or (self.ttl_ms is not None and created <= ts - self.ttl_ms):
                    stored, created = None, ts
                keep.append(digest != stored)
                stored = digest
            self.entries.updateValue((k,), (stored, created))
        yield pdf[keep][["k", "ts", "ord", "hash"]]

    def close(self) -> None:
        pass


class Lifecycle(StatefulProcessor):
    """Online, stale and offline events; an event-time timer closes the open tail."""

    COLUMNS = ["asset_id", "previous_state", "new_state", "timestamp_ms", "reason"]

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "state string, last_data bigint")

    def _stale(self, key, last: int) -> tuple:
        return (key[0], "online", "stale", last + self.stale_ms, f"no_data_for_{self.stale_ms // 1000}s")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, "ts", "rank", "seq")
        state, last = self.status.get() if self.status.exists() else (None, None)
        out = []
        for ts, rank in zip(pdf["ts"].to_numpy(), pdf["rank"].to_numpy()):
            ts = int(ts)
            if state == "online" and ts - last > self.stale_ms:
                out.append(self._stale(key, last))
                state = "stale"
            if rank == 0:
                if state != "online":
                    reason = "first_seen" if state is None else "data_received"
                    out.append((key[0], state, "online", ts, reason))
                state, last = "online", ts
            elif state in ("online", "stale"):
                out.append((key[0], state, "offline", ts, "ddeath"))
                state = "offline"
        if state is not None:
            self.status.update((state, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "online":
            self.handle.registerTimer(last + self.stale_ms)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last = self.status.get() if self.status.exists() else (None, None)
        out = []
        if state == "online":
            self.status.update(("stale", last))
            out.append(self._stale(key, last))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


class Forest(StatefulProcessor):
    """Score each observation against the masses so far, then count it.

    The state holds the counts of the last nodes that any row reached, so it grows with the
    rows of its key up to the size of the trees, and is small for a key of few rows.
    """

    def __init__(self, trees: int, depth: int, window: int, seed: int):
        self.shape = (trees, depth, window, seed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trees = online.Replay(*self.shape)
        self.model = handle.getValueState("model", "counts binary, lo array<double>, hi array<double>, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        trees = self.trees
        ts, order, f = _columns(rows, "ts", "ord", "f")
        trees.start()
        stored = self.model.get()
        if stored is not None:
            raw, lo, hi, trees.seen = stored
            trees.load(*np.frombuffer(zlib.decompress(raw), dtype="int32").reshape(2, -1))
            trees.low, trees.high = np.array(lo), np.array(hi)
        first = trees.seen == 0
        scores = 1.0 - trees.run(np.stack(f)) / (len(trees.dims) * trees.depth * trees.window)
        if first:
            scores[0] = 0.5
        raw = zlib.compress(np.stack(trees.last_counts()).astype("int32").tobytes(), 1)
        self.model.update((raw, trees.low.tolist(), trees.high.tolist(), trees.seen))
        yield pd.DataFrame({"k": key[0], "ts": ts, "ord": order, "score": scores})

    def close(self) -> None:
        pass


def use_rocksdb(spark) -> None:
    """State beyond memory; the processors need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _event_time(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(ts)).withWatermark("event_time", delay)


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Deal rows by a bucket of ``k``; it is a key's place in the state, so a checkpoint keeps its number of buckets."""
    return rows.withColumn("bucket", F.pmod(F.hash("k"), F.lit(buckets))).repartition("bucket")


def cooldown_stream(rows: DataFrame, cooldown_ms: int) -> DataFrame:
    """``rows`` has k, ts and ord; gives the emitted ones."""
    return rows.groupBy("k").transformWithStateInPandas(
        Cooldown(cooldown_ms), "k string, ts bigint, ord string", "Append", "None"
    )


def changed_stream(rows: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` has k, ts, ord and value_json; gives the changed ones. A task holds one bucket's rows of a batch."""
    # Hashed behind the exchange, which also serves the grouping.
    hashed = _in_buckets(rows, buckets).select(
        "bucket", "k", "ts", "ord", dedup.value_hash(F.col("value_json")).alias("hash")
    )
    return hashed.groupBy("bucket").transformWithStateInPandas(
        Changed(ttl_ms), "k string, ts bigint, ord string, hash string", "Append", "None"
    )


def lifecycle_stream(activity: DataFrame, stale_ms: int, delay: str = "1 hour") -> DataFrame:
    """State changes of an activity stream; rows later than the watermark are dropped
    and counted in the query's progress (``numRowsDroppedByWatermark``)."""
    ranked = activity.withColumn("rank", F.when(F.col("kind") == "data", 0).otherwise(1))
    return _event_time(ranked, delay=delay).groupBy("asset_id").transformWithStateInPandas(
        Lifecycle(stale_ms),
        "asset_id string, previous_state string, new_state string, timestamp_ms bigint, reason string",
        "Append",
        "EventTime",
    )


def anomaly_stream(
    metrics: DataFrame,
    trees: int = anomaly.TREES,
    depth: int = anomaly.DEPTH,
    window: int = anomaly.WINDOW,
    seed: int = anomaly.SEED,
) -> DataFrame:
    """Score then update, per asset and in time order."""
    rows = metrics.filter("value_num IS NOT NULL").select(
        F.col("asset_id").alias("k"),
        F.col("timestamp_ms").alias("ts"),
        F.col("elem_order").alias("ord"),
        anomaly.features().alias("f"),
    )
    return rows.groupBy("k").transformWithStateInPandas(
        Forest(trees, depth, window, seed), "k string, ts bigint, ord string, score double", "Append", "None"
    )
