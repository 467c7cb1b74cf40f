"""Ordered scans that stay parallel when one key holds a large share of the rows.

A plain window over (key order by time) puts a whole key into one task. Here the
time line is cut into slices: the window runs per (key, slice), and one summary
row per (key, slice) carries what is needed across the cuts. The data is shuffled
once, by (key, slice); the summaries are built with partial aggregation and there
is at most one per key and slice of the time line. Keys must not be NULL and the
order columns must be unique per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantweave.session import ensure_checkpoint_dir

HOUR_MS = 3_600_000
_SLICE = "_slice"


def time_slice(ts_ms: Column, width_ms: int = HOUR_MS) -> Column:
    """Start of the slice of the time line that holds the instant."""
    return ts_ms - F.pmod(ts_ms, F.lit(width_ms))


def slice_width(df: DataFrame, ts: str, rows: int) -> int:
    """Width in ms of slices that hold about ``rows`` rows of the whole table, an hour at most."""
    first, last, n = df.agg(F.min(ts), F.max(ts), F.count(ts)).first()
    return HOUR_MS if not n else max(1, min(HOUR_MS, (last - first + 1) * rows // n))


def lag_in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ts: str,
    previous: dict[str, str],
    width_ms: int = HOUR_MS,
) -> DataFrame:
    """Add the preceding row's columns; ``previous`` maps new name to source column.

    ``order[0]`` must be ``ts`` or follow it.
    """
    sliced = df.withColumn(_SLICE, time_slice(F.col(ts), width_ms))
    row = F.struct(*[F.col(src).alias(out) for out, src in previous.items()])
    over_slices = Window.partitionBy(*keys).orderBy(_SLICE)
    carried = (
        sliced.groupBy(*keys, _SLICE)
        .agg(F.max_by(row, F.struct(*order)).alias("_last"))
        .select(*keys, _SLICE, F.lag("_last").over(over_slices).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    joined = sliced.join(carried, [*keys, _SLICE]).withColumn(
        "_prev", F.coalesce(F.lag(row).over(inside), F.col("_carry"))
    )
    return joined.select(
        *[joined[c] for c in df.columns], *[F.col(f"_prev.{out}").alias(out) for out in previous]
    )


def running_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ts: str,
    totals: dict[str, tuple[str, Column]],
    width_ms: int = HOUR_MS,
) -> DataFrame:
    """Add running ``max``, ``sum`` or ``count`` over the rows before each row.

    ``totals`` maps new name to (kind, column). ``max`` is NULL before the first
    value; ``sum`` and ``count`` start at 0.
    """
    agg = {"max": F.max, "sum": F.sum, "count": F.count}
    sliced = df.withColumn(_SLICE, time_slice(F.col(ts), width_ms))
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    kinds = {out: kind for out, (kind, _) in totals.items()}
    merge = {"max": F.max, "sum": F.sum, "count": F.sum}
    carried = (
        sliced.groupBy(*keys, _SLICE)
        .agg(*[agg[kind](col).alias(f"_in_{out}") for out, (kind, col) in totals.items()])
        .select(
            *keys,
            _SLICE,
            *[merge[k](f"_in_{out}").over(before).alias(f"_carry_{out}") for out, k in kinds.items()],
        )
    )
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = sliced.join(carried, [*keys, _SLICE])

    def combined(out: str, kind: str, col: Column) -> Column:
        local = agg[kind](col).over(inside)
        if kind == "max":
            return F.greatest(local, F.col(f"_carry_{out}"))
        return F.coalesce(local, F.lit(0)) + F.coalesce(F.col(f"_carry_{out}"), F.lit(0))

    return joined.select(
        *[joined[c] for c in df.columns],
        *[combined(out, kind, col).alias(out) for out, (kind, col) in totals.items()],
    )


def number_in_order(
    df: DataFrame, keys: list[str], order: list[str], ts: str, out: str, width_ms: int = HOUR_MS
) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return running_before(df, keys, order, ts, {out: ("count", F.lit(1))}, width_ms)


def number_globally(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add a 0-based position over the whole table by a distributed sort.

    The sorted rows are checkpointed once, so the sizes of the sorted pieces and
    the rows themselves agree even if an executor is lost afterwards.
    """
    from plantweave.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    piece, offset = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    # One row per sorted piece, so the window below is as small as the piece count.
    starts = (
        placed.groupBy(piece.alias("_piece"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_piece",
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_start"),
        )
    )
    return (
        placed.withColumn("_piece", piece)
        .join(F.broadcast(starts), "_piece")
        .withColumn(out, F.col("_start") + offset)
        .drop("_piece", "_id", "_start")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, by partial aggregation rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; Spark limits each key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


_BUCKETS = 1024


def first_rows(df: DataFrame, key: str, ties: list[str], n: int, descending: bool = False) -> DataFrame:
    """The first ``n`` rows by ``key`` (whole numbers), then by ``ties``; no task holds the ``n`` rows.

    A histogram of ``key`` (values within a range of 2^62) finds the bucket in which the n-th row lies, the next one divides that
    bucket, until it is one value. Rows before that value are taken by a filter. Only rows
    with that value are dealt out by ranges of ``ties``, and one range is cut at a row. A null
    key is less than all others. Rows equal in key and ties are interchangeable. ``df`` is read
    several times and must give the same rows each time.
    """
    if n <= 0:
        return df.limit(0)
    value = F.col(key).cast("long")
    low, high, rows = df.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    if rows <= n:
        return df
    if low is None:
        low = high = 0
    # Ascending ranks either way; nulls get the rank beside the least value.
    low, high, null = (-high, -low, -low + 1) if descending else (low, high, low - 1)
    rank = F.coalesce(-value if descending else value, F.lit(null).cast("long"))
    low, high, wanted = min(low, null), max(high, null), n
    while low < high:
        width = (high - low) // _BUCKETS + 1
        bucket_of = F.call_function("div", rank - F.lit(low), F.lit(width)).alias("bucket")
        counts = df.filter(rank.between(low, high)).groupBy(bucket_of).count().orderBy("bucket").collect()  # few rows
        for bucket, count in counts:
            if wanted <= count:
                break
            wanted -= count
        low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
    before, at = df.filter(rank < low), df.filter(rank == low)
    return before.unionByName(_first_by_ranges(at, ties, wanted))


def _first_by_ranges(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows: whole ranges of the order, and of one range the first rows."""
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    cut, left = -1, n
    for part, count in dealt.groupBy("_part").count().orderBy("_part").collect():  # one row per range
        cut = part
        if left <= count:
            break
        left -= count
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    some = dealt.filter(F.col("_part") == cut).withColumn("_place", place).filter(F.col("_place") <= left).drop("_place")
    return dealt.filter(F.col("_part") < cut).unionByName(some).drop("_part")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by keys for a compute-heavy step.

    The explicit number keeps adaptive execution from folding the step into few tasks
    because its input is small in bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
