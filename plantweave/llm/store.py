"""Intermediate tables in the shared folder, and documents packed into blocks.

A block is one row that holds a few megabytes of whole documents, compressed. The
operators that read the corpus several times (repeated phrases, Jaccard join) write
the blocks once and then move a few thousand rows instead of all documents.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantweave.llm.words import lower_ascii

#: Settings of the jobs that write intermediate tables: shuffle files go as soon as a job
#: has ended, and texts pass between Spark and Python in batches of a few megabytes.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

BLOCK_SCHEMA = "block long, n int, ids binary, missing binary, lengths binary, texts binary"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="corpus-")
    return f"{base.rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def lean_jobs(spark: SparkSession) -> Iterator[None]:
    """Jobs inside run with ``_SETTINGS``; the session's own settings return afterwards."""
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    try:
        for key, value in _SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with lean_jobs(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, bounds and validity of a string column; a null text is an empty one."""
    valid = np.asarray(column.is_valid())
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0], valid


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``size`` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # Each row counts some bytes more, so that rows without text fill pieces too.
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64) + 64
        group = (np.cumsum(lengths) - lengths) // size
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


class Block:
    """Documents of one block: ids (null ids are marked), bounds and the bytes of all texts."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.missing = np.frombuffer(row["missing"], dtype=bool)
        lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.bounds = np.r_[0, np.cumsum(lengths)]
        raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(self.bounds[-1])))
        self.raw = np.frombuffer(raw, dtype=np.uint8)

    def text(self, i: int) -> bytes:
        return self.raw[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def __len__(self) -> int:
        return len(self.ids)


def block_row(number: int, ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, texts: bytes) -> dict:
    return {
        "block": number,
        "n": len(ids),
        "ids": ids.astype(np.int64).tobytes(),
        "missing": missing.astype(bool).tobytes(),
        "lengths": lengths.astype(np.int64).tobytes(),
        "texts": zstandard.ZstdCompressor(level=1).compress(texts),
    }


def rows_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


BLOCK_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("n", pa.int32()),
        ("ids", pa.binary()),
        ("missing", pa.binary()),
        ("lengths", pa.binary()),
        ("texts", pa.binary()),
    ]
)


def pack_blocks(docs: DataFrame, size: int, in_order: bool, lower: bool = False) -> DataFrame:
    """Rows (key long or null, text) as blocks of about ``size`` bytes of text.

    With ``in_order`` the blocks are ranges of keys: a block's keys are not above those
    of a block with a larger number, null keys come last, and rows of one key share a block.
    With ``lower`` the letters A-Z become lower case.
    """
    spark = docs.sparkSession
    if in_order:
        # Nulls last, so the largest integer stands for them while rows are dealt out.
        dealt = docs.withColumn("place", F.coalesce("key", F.lit(2**63 - 1)))
        docs = dealt.repartitionByRange(partitions(spark), "place").sortWithinPartitions("place", "key").drop("place")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        held_bytes, count = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, held_bytes, count
            ids, missing, lengths = (np.concatenate([h[i] for h in held]) for i in range(3))
            row = block_row((part << 20) + count, ids, missing, lengths, b"".join(h[3] for h in held))
            held, held_bytes, count = [], 0, count + 1
            return rows_batch([row], BLOCK_ARROW)

        for batch in slices(batches, "text", size):
            key = batch.column("key")
            missing = np.asarray(key.is_null())
            ids = np.asarray(key.fill_null(2**63 - 1), dtype=np.int64)
            raw, bounds, _ = text_buffers(batch.column("text"))
            raw = lower_ascii(raw) if lower else raw
            # Rows of the key that ends the open block still belong to it.
            same = 0
            if held and held_bytes >= size:
                while in_order and same < len(ids) and ids[same] == held[-1][0][-1]:
                    same += 1
                if same:
                    held.append((ids[:same], missing[:same], np.diff(bounds[: same + 1]), raw[: bounds[same]].tobytes()))
                if same < len(ids) or not in_order:
                    yield flush()
            if same < len(ids):
                rest = raw[bounds[same] :].tobytes()
                held.append((ids[same:], missing[same:], np.diff(bounds[same:]), rest))
                held_bytes += len(rest) + 64 * (len(ids) - same)
        if held:
            yield flush()

    return docs.select("key", "text").mapInArrow(pack, BLOCK_SCHEMA)
