"""Sums over the rows before each row of one sorted table, without a window over the whole.

The table is dealt out by ranges of the order and sorted; each piece counts on its own while
it is written, and the pieces' totals (one row per piece) tell where each of them begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plantweave.llm import store


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Add per entry of ``sums`` the sum of its column (long, no nulls) over all rows before the row.

    Rows that are equal in ``order`` follow each other in any order. The result is read from
    a table written once, so its order does not change when a task is repeated.
    """
    spark, outs = df.sparkSession, list(sums)
    placed = (
        df.withColumns({out: column.cast("long") for out, column in sums.items()})
        .repartitionByRange(store.partitions(spark), *order)
        .sortWithinPartitions(*order)
    )
    own = {out: f"own{i}__" for i, out in enumerate(outs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried = TaskContext.get().partitionId(), dict.fromkeys(outs, 0)
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for out in outs:
                values = np.asarray(batch.column(out), dtype=np.int64)
                total = np.cumsum(values) + carried[out]
                columns[names.index(out)] = pa.array(total - values)
                columns.append(pa.array(values))
                carried[out] = int(total[-1]) if len(total) else carried[out]
            columns.append(pa.array(np.full(batch.num_rows, part, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *own.values(), "part__"])

    extra = [StructField(n, LongType()) for n in own.values()] + [StructField("part__", IntegerType())]
    written = store.materialise(placed.mapInArrow(run, StructType([*placed.schema.fields, *extra])), name)
    # One row per piece of the table: as many as there are shuffle partitions.
    totals = written.groupBy("part__").agg(*[F.sum(own[o]).alias(o) for o in outs]).orderBy("part__").collect()
    start, starts = dict.fromkeys(outs, 0), []
    for row in totals:
        starts.append((row["part__"], *[start[o] for o in outs]))
        start = {o: start[o] + row[o] for o in outs}
    begins = {o: f"begin{i}__" for i, o in enumerate(outs)}
    table = spark.createDataFrame(starts, "part__ int, " + ", ".join(f"{b} long" for b in begins.values()))
    joined = written.join(F.broadcast(table), "part__")
    return joined.select(*[(F.col(c) + F.col(begins[c])).alias(c) if c in begins else F.col(f"`{c}`") for c in placed.columns])
