"""Exact top-k by inner product over a bit-sliced index.

Vectors of integers are indexed in blocks. Per attribute a block keeps the upper bits of its
values as slices, bitmaps over the block's rows. For a query the slices are added up with
bitmap arithmetic (full adders, weighted by the bits of the query's values), which gives
every row's approximate score as slices again. The k-th largest is read off from the most
significant slice downward. Cutting the lower bits changes a score by at most a known
amount, so only rows within that of the k-th can be in the result; they are resolved with
the exact integers. Queries meet the index in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantweave.llm import store

_INDEX = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("low", pa.int64()), ("shift", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("slices", pa.binary())]
)
_INDEX_DDL = "block long, dim int, low long, shift int, ids binary, values binary, slices binary"


def _slices_of(values: np.ndarray, bits: int) -> tuple[int, int, np.ndarray]:
    """Lowest value, bits cut off, and slices (attribute, bit, word) of rows x attributes."""
    low = int(values.min()) if values.size else 0
    reach = int(values.max()) - low if values.size else 0
    shift = max(0, reach.bit_length() - bits)
    upper = ((values - low) >> shift).T.astype(np.int64)
    words = -(-values.shape[0] // 64)
    out = np.zeros((values.shape[1], bits, words * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits(((upper >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return low, shift, out.view(np.uint64)


def _build(block_rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal count
            ids = np.concatenate([h[0] for h in held[dim]])
            values = np.concatenate([h[1] for h in held[dim]])
            held[dim] = []
            for a in range(0, len(ids), block_rows):
                own = values[a : a + block_rows]
                low, shift, slices = _slices_of(own, bits)
                row = {"block": (part << 20) + count, "dim": dim, "low": low, "shift": shift}
                row |= {"ids": ids[a : a + block_rows].tobytes(), "values": own.tobytes(), "slices": slices.tobytes()}
                count += 1
                yield store.rows_batch([row], _INDEX)

        for batch in batches:
            vectors = batch.column("ints")
            sizes = np.diff(np.asarray(vectors.offsets))
            flat = np.asarray(vectors.flatten(), dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            ids = np.asarray(batch.column("id"), dtype=np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                values = flat[starts[rows][:, None] + np.arange(dim)]
                held.setdefault(int(dim), []).append((ids[rows], values))
                if sum(len(h[0]) for h in held[int(dim)]) >= block_rows:
                    yield from flush(int(dim))
        for dim in list(held):
            if held[dim]:
                yield from flush(dim)

    return run


def _add(level: list[list[np.ndarray]], weight: int, bitmap: np.ndarray) -> None:
    """Put a bitmap on a weight; three on one weight become a sum there and a carry above."""
    while True:
        level[weight].append(bitmap)
        if len(level[weight]) < 3:
            return
        a, b, c = level[weight]
        half = a ^ b
        level[weight] = [half ^ c]
        half &= c
        a &= b
        half |= a
        bitmap, weight = half, weight + 1


def _sum_slices(slices: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Slices (query, word) of sum(|q| * v), v the upper bits, complemented where q is negative."""
    dims, bits, words = slices.shape
    size = np.abs(queries)
    ones = np.uint64(2**64 - 1)
    negative = np.where(queries < 0, ones, np.uint64(0))
    top = int(size.max(initial=0)).bit_length()
    level: list[list[np.ndarray]] = [[] for _ in range(bits + top + dims.bit_length() + 3)]
    for d in range(dims):
        masks = [(j, np.where((size[:, d] >> j) & 1, ones, np.uint64(0))[:, None]) for j in range(top)]
        masks = [(j, m) for j, m in masks if m.any()]
        for b in range(bits):
            slice_ = slices[d, b][None, :] ^ negative[:, d][:, None]
            for j, mask in masks:
                _add(level, b + j, slice_ & mask)
    # At most two bitmaps are left on each weight: one ripple through all of them.
    zero = np.zeros((len(queries), words), dtype=np.uint64)
    out, carry = [], zero
    for pair in level:
        a, b = (pair + [zero, zero])[:2]
        half = a ^ b
        out.append(half ^ carry)
        carry = (a & b) | (half & carry)
    return out


def _kth_largest(sums: list[np.ndarray], rows: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Per query: the largest value that at least k of its rows reach, most significant slice first."""
    found = np.zeros(len(k), dtype=np.int64)
    sure, open_ = np.zeros_like(rows), rows.copy()
    for weight in range(len(sums) - 1, -1, -1):
        ahead = open_ & sums[weight]
        enough = np.bitwise_count(sure | ahead).sum(axis=1, dtype=np.int64) >= k
        found |= enough.astype(np.int64) << weight
        sure = np.where(enough[:, None], sure, sure | ahead)
        open_ = np.where(enough[:, None], ahead, open_ & ~sums[weight])
    return found


def _at_least(sums: list[np.ndarray], rows: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose value is not below the query's bar."""
    above, equal = np.zeros_like(rows), rows.copy()
    for weight in range(len(sums) - 1, -1, -1):
        one = ((bar >> weight) & 1).astype(bool)[:, None]
        above = np.where(one, above, above | (equal & sums[weight]))
        equal = np.where(one, equal & sums[weight], equal & ~sums[weight])
    return above | equal


def search_block(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, bits: int):
    """The k best rows of one index block for each query: (query, row id, exact score)."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    values = np.frombuffer(row["values"], dtype=np.int64).reshape(len(ids), row["dim"])
    words = -(-len(ids) // 64)
    slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(row["dim"], bits, words)
    bitmap = np.packbits(np.r_[np.ones(len(ids), np.uint8), np.zeros(words * 64 - len(ids), np.uint8)], bitorder="little")
    rows = np.repeat(bitmap.view(np.uint64)[None, :], len(queries), axis=0)
    # A query's own row is no candidate.
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids[order], query_ids, side=s) for s in ("left", "right"))
    for q in np.flatnonzero(hi > lo):
        for r in order[lo[q] : hi[q]]:
            rows[q, r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
    sums = _sum_slices(slices, queries)
    wanted = np.minimum(k, np.bitwise_count(rows).sum(axis=1, dtype=np.int64))
    cut = (1 << int(row["shift"])) - 1
    # Cut-off bits move a score by up to cut * sum|q|; in units of the slices, rounded up.
    slack = -(-cut * np.abs(queries).sum(axis=1) >> int(row["shift"]))
    bar = np.maximum(0, _kth_largest(sums, rows, wanted) - slack)
    picked = _at_least(sums, rows, bar)
    out_q, out_id, out_score = [], [], []
    for q in range(len(queries)):
        near = np.flatnonzero(np.unpackbits(picked[q].view(np.uint8), bitorder="little"))
        score = values[near] @ queries[q]
        best = np.lexsort((ids[near], -score))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_id.append(ids[near][best])
        out_score.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def _pack_queries(table: pa.Table) -> pa.Table:
    schema = pa.schema([("team", pa.int64()), ("dim", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary())])
    rows = []
    sizes = np.array([len(v) for v in table.column("ints").to_pylist()])
    ids = np.asarray(table.column("id"), dtype=np.int64)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        values = np.array([table.column("ints")[int(i)].as_py() for i in own], dtype=np.int64).reshape(len(own), dim)
        rows.append({"team": table.column("team")[0].as_py(), "dim": int(dim), "query_ids": ids[own].tobytes(), "queries": values.tobytes()})
    return pa.Table.from_pylist(rows, schema=schema)


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """Rows (id, ints) with floor(scale * x) of each component; vectors with a null or non-finite one are left out."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")))
    usable = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & finite)
    return usable.select(F.col(id_column).cast("long").alias("id"), ints.alias("ints"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = 256.0,
    bits: int = 6,
    block_rows: int = 2048,
    team_size: int = 256,
) -> DataFrame:
    """Per query (rows for which ``is_query`` holds): ``query_id``, ``rank`` from 1, the row's id and ``score``.

    The score is the inner product of the integer vectors, exact; ties go to the smaller
    id. All rows are candidates but those with the query's id; if there are fewer than
    ``k``, all are returned. Rows without id or with an unusable vector take no part, and
    vectors of different length never meet. Rows that repeat an id are candidates of their
    own; as queries they count once, with the smallest vector. Other columns are not read.
    ``bits``, ``block_rows`` and ``team_size`` change the plan only.
    """
    rows = integer_vectors(vectors, id_column, vector_column, scale)
    index = store.materialise(rows.mapInArrow(_build(block_rows, bits), _INDEX_DDL), "bit-slices")
    asked = integer_vectors(vectors.filter(is_query), id_column, vector_column, scale).groupBy("id").agg(F.min("ints").alias("ints"))
    asked = store.materialise(asked, "queries")
    teams = max(1, -(-asked.count() // team_size))
    packed = (
        asked.withColumn("team", F.pmod(F.xxhash64("id"), F.lit(teams)))
        .groupBy("team")
        .applyInArrow(_pack_queries, "team long, dim int, query_ids binary, queries binary")
    )
    # The query set against all rows, in blocks: each index block meets each team once.
    pairs = index.select("block", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(teams - 1).cast("long"))).alias("team"))
    schema = pa.schema([("query_id", pa.int64()), (id_column, pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                query_ids = np.frombuffer(row["query_ids"], dtype=np.int64)
                queries = np.frombuffer(row["queries"], dtype=np.int64).reshape(len(query_ids), row["dim"])
                found = search_block(row, query_ids, queries, k, bits)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    met = pairs.join(packed, ["team", "dim"]).join(index.drop("dim"), "block")
    best = met.repartition("block", "team").mapInArrow(search, f"query_id long, `{id_column}` long, score long")
    best = store.materialise(best, "block-tops")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", id_column, "score")
