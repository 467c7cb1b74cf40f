"""Draw documents that look like a target collection: hashed features, importance weights, Gumbel top-k.

Features are runs of words. Each is hashed by the CRC-32 of its bytes into one of ``buckets``
buckets; a bucket's gain is the log ratio of its share in the target and in all documents, and a
document weighs the mean of its features' gains. Adding Gumbel noise drawn from the document's id
and taking the highest scores draws without replacement in proportion to the exponential weights.

CRCs are computed for many features at once: a batch's distinct features are grouped by their
length into two-dimensional byte arrays, all rows of an array advance one column at a time, and
the buckets are scattered back to the features' places.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plantweave.llm import running, store
from plantweave.llm.words import ALNUM, Words, lower_ascii

#: The reflected generator polynomial of CRC-32 (a fixed value).
_POLYNOMIAL = 0xEDB88320
#: A feature of more bytes fills an array of its own, so zlib reads it in one go.
WIDEST = 512
#: Bytes of features that are hashed together.
_CHUNK = 4 << 20


@functools.lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """What each byte value does to a CRC."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each column of ``rows``: byte i of all features is row i, so a step reads one row."""
    steps, crc = _steps(), np.full(rows.shape[1], 0xFFFFFFFF, dtype=np.uint32)
    for column in rows:
        crc = steps[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_by_length(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of ``raw[starts[i]:starts[i] + lengths[i]]`` for all i."""
    out = np.empty(len(starts), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(lengths[order])) + 1, len(order)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        own, length = order[a:b], int(lengths[order[a]])
        if length > WIDEST:
            out[own] = [zlib.crc32(raw[s : s + length].tobytes()) for s in starts[own]]
        else:
            out[own] = crc_matrix(raw[starts[own] + np.arange(length)[:, None]])
    return out


def feature_buckets(words: Words, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all features of all texts, in bounded pieces."""
    widths = words.ends - words.starts
    if not len(widths):
        return
    # All words behind each other with one space between them: a run of words is a stretch of that.
    begins = np.cumsum(widths + 1) - widths - 1
    ends = begins + widths
    joined = np.full(int(ends[-1]) + 1, 0x20, dtype=np.uint8)
    for a in range(0, len(widths), _CHUNK >> 3):
        own = slice(a, a + (_CHUNK >> 3))
        _copy(joined, begins[own], words.raw, words.starts[own], widths[own])
    for k in range(1, runs + 1):
        heads = words.run_starts(k)
        lengths = ends[heads + k - 1] - begins[heads]
        piece = np.cumsum(lengths) // _CHUNK
        cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, len(heads)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                yield words.doc[heads[a:b]], _buckets(joined, begins[heads[a:b]], lengths[a:b], buckets)


def _copy(into: np.ndarray, at: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    if len(lengths) == 1:
        into[at[0] : at[0] + lengths[0]] = raw[starts[0] : starts[0] + lengths[0]]
        return
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    into[np.repeat(at, lengths) + inside] = raw[np.repeat(starts, lengths) + inside]


def _buckets(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each feature; equal features are hashed once."""
    bounds = np.r_[0, np.cumsum(lengths)]
    data = np.empty(int(bounds[-1]), dtype=np.uint8)
    _copy(data, bounds[:-1], raw, starts, lengths)
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers).dictionary_encode()
    _, offsets, bytes_ = coded.dictionary.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[: len(coded.dictionary) + 1]
    crc = crc_by_length(np.frombuffer(bytes_, dtype=np.uint8), offsets[:-1], np.diff(offsets))
    return (crc.astype(np.int64) % buckets)[np.asarray(coded.indices)]


def _words(batch: pa.RecordBatch) -> Words:
    raw, bounds, _ = store.text_buffers(batch.column("text__"))
    return Words(lower_ascii(raw), bounds, ALNUM)


def bucket_counts(docs: DataFrame, text_column: str, runs: int, buckets: int) -> np.ndarray:
    """Features per bucket over all texts: each task counts, and Spark adds the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in store.slices(batches, "text__", _CHUNK):
            for _, bucket in feature_buckets(_words(batch), runs, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text_column}`").alias("text__")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    size, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_corpus + size) / (float(s + 1) * float(all_target + size))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, runs: int, id_column: str, text_column: str) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight), one per document."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches, "text__", _CHUNK):
            words, n = _words(batch), batch.num_rows
            total, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for doc, bucket in feature_buckets(words, runs, buckets):
                # Features come in text order, so each text's are one stretch.
                cuts = np.flatnonzero(np.r_[True, np.diff(doc) > 0])
                total[doc[cuts]] += np.add.reduceat(gains[bucket], cuts)
                count += np.bincount(doc, minlength=n)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            arrays = [batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (words.counts, count, weight)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text__"))
    fields = [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *fields]))


def resample(
    docs: DataFrame,
    target: DataFrame,
    runs: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    share: tuple[int, int] = (10, 100),
    seed: str = "2024",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank); ``rank`` is null for documents that are not drawn.

    Of the N documents with ``least_words`` words, floor(N * share) are drawn. A null or empty text
    has no words, weight 0 and is never drawn; a null id gives the noise of an empty id and comes
    after all ids among equal scores. Rows that repeat an id get the same noise and are drawn one by
    one, those with fewer features first. An empty table of documents gives no rows, an empty
    target smoothed shares alone. Other columns, whatever their names, are not read. Texts of any
    length are read whole; features of more than ``WIDEST`` bytes are hashed one at a time.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, text_column, runs, buckets), bucket_counts(target, text_column, runs, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    point = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(point)))
    scored = weigh(docs, gains, runs, id_column, text_column).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = store.materialise(scored, "resample-scores")
    drawable = F.col("n_words") >= least_words
    # Scores are thousandths of logarithms: tens of thousands of different ones, however many documents.
    levels = sorted(map(tuple, scored.filter(drawable).groupBy("score").count().collect()), reverse=True)
    wanted = sum(n for _, n in levels) * share[0] // share[1]
    lowest, seen = None, 0
    for level, n in levels:
        if seen >= wanted:
            break
        lowest, seen = level, seen + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = drawable & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    # Rows equal in all that have no order; a hash of their places deals them to several tasks.
    candidates = scored.filter(near).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    ranked = running.sums_before(candidates, [*order, F.col("spread")], {"rank": F.lit(1)}, "resample-ranks")
    rank = F.when(F.col("rank") < wanted, F.col("rank") + 1).alias("rank")
    rest = scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank).unionByName(rest)
