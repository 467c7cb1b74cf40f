"""Benchmark decontamination by winnowing.

Every window of ten words holds six runs of five words; the run with the smallest hash
is a fingerprint, in training texts and in benchmark items alike. Two texts that share a
window therefore share a fingerprint of it. Fingerprints are joined, and each hit is
extended to the windows around it. Shorter items are one window each and match as a whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantweave.llm import store
from plantweave.llm.words import ALNUM, Words, lower_ascii, runs

_ARROW = pa.schema(
    [
        ("key", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_SCHEMA = "key long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
_LARGEST = np.uint64(2**64 - 1)


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(lower_ascii(raw), bounds, ALNUM)
    return words, words.hashes()


def fingerprints(grams: np.ndarray, at: np.ndarray, per_window: int) -> np.ndarray:
    """Indices of the runs that are smallest in some window; ``at``: first runs of the windows.

    All runs that tie for the smallest are kept, so equal windows always agree.
    """
    n = len(grams)
    if not n or not len(at):
        return np.zeros(0, dtype=np.int64)
    least = np.full(n, np.uint64(0))
    smallest = grams[at]
    for j in range(1, per_window):
        smallest = np.minimum(smallest, grams[at + j])
    least[at] = smallest
    # A run is kept if it equals the smallest of a window that holds it.
    bar = least.copy()
    for j in range(1, per_window):
        bar[j:] = np.maximum(bar[j:], least[:-j])
    return np.flatnonzero((grams <= bar) & (bar > 0))


class BenchmarkBlock:
    """A bounded part of the benchmark: word hashes, window hashes and fingerprints."""

    def __init__(self, names: list[str], texts: list[str], window: int, gram: int):
        raw, bounds, _ = store.text_buffers(pa.array(texts, pa.large_string()))
        words, hashes = _words(raw, bounds)
        self.names, self.doc = names, words.doc
        at = words.run_starts(window)
        self.windows = np.zeros(len(hashes), dtype=np.uint64)  # 0: no window starts here
        self.windows[at] = runs(hashes, window)[at] | np.uint64(1)
        grams = runs(hashes, gram)
        picked = fingerprints(grams, at, window - gram + 1)
        order = np.argsort(grams[picked], kind="stable")
        self.prints, self.places = grams[picked][order], picked[order]
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(words.counts[(words.counts > 0) & (words.counts < window)]):
            items = np.flatnonzero(words.counts == n)
            keys = runs(hashes, int(n))[words.first[items]]
            order = np.argsort(keys, kind="stable")
            self.whole[int(n)] = (keys[order], items[order])


def _expand(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index into keys, index into the sorted table) of equal hashes."""
    lo = np.searchsorted(table, keys, side="left")
    n = np.searchsorted(table, keys, side="right") - lo
    left = np.repeat(np.arange(len(keys)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _search(words: Words, hashes: np.ndarray, bench: BenchmarkBlock, window: int, gram: int):
    """Runs of hit words as (first word, words) and pairs (document, item)."""
    at = words.run_starts(window)
    grams = runs(hashes, gram)
    starts, sizes, docs, items = [], [], [], []
    if len(at) and len(bench.prints):
        own = np.zeros(len(hashes), dtype=np.uint64)
        own[at] = runs(hashes, window)[at] | np.uint64(1)
        picked = fingerprints(grams, at, window - gram + 1)
        picked = picked[np.isin(grams[picked], bench.prints)]
        for part in np.array_split(picked, max(1, len(picked) // 4096)):
            left, right = _expand(grams[part], bench.prints)
            here, there = part[left], bench.places[right]
            for back in range(window - gram + 1):
                s, t = here - back, there - back
                ok = (s >= 0) & (t >= 0)
                s, t = s[ok], t[ok]
                same = (own[s] == bench.windows[t]) & (own[s] != 0)
                starts.append(s[same])
                sizes.append(np.full(same.sum(), window))
                docs.append(words.doc[s[same]])
                items.append(bench.doc[t[same]])
    for n, (keys, whole) in bench.whole.items():
        first = words.run_starts(n)
        hit = runs(hashes, n)[first]
        near = np.isin(hit, keys)
        left, right = _expand(hit[near], keys)
        s = first[near][left]
        starts.append(s)
        sizes.append(np.full(len(s), n))
        docs.append(words.doc[s])
        items.append(whole[right])
    if not starts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x).astype(np.int64) for x in (starts, sizes, docs, items))


def _result(ids: pa.Array, words: Words, covered: np.ndarray, named: list[list[str]], kept: dict[str, pa.Array]) -> pa.RecordBatch:
    """``covered``: hit or not, per word of all documents."""
    edge = np.diff(np.r_[0, covered.view(np.int8), 0])
    # A span ends at its document's end.
    cut = words.first[1:-1]
    cut = cut[(cut > 0) & (cut < len(covered))]
    cut = np.unique(cut[(covered[cut - 1] & covered[cut]) > 0]) if len(cut) else cut
    heads = np.sort(np.r_[np.flatnonzero(edge == 1), cut])
    tails = np.sort(np.r_[np.flatnonzero(edge == -1), cut])
    doc = words.doc[heads]
    offsets = np.searchsorted(doc, np.arange(len(words.counts) + 1))
    first = words.first[doc]
    spans = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()),
        pa.StructArray.from_arrays([pa.array(heads - first, pa.int32()), pa.array(tails - first, pa.int32())], ["start", "end"]),
    )
    total = np.r_[0, np.cumsum(covered)]
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()),
            pa.array(words.counts, pa.int64()),
            pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()),
            spans,
            pa.array(named, pa.list_(pa.string())),
            *kept.values(),
        ],
        names=[*_ARROW.names, *kept],
    )


def _scan(block, window: int, gram: int, batch_bytes: int, text_column: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: BenchmarkBlock = block.value
        for batch in store.slices(batches, text_column, batch_bytes):
            raw, bounds, _ = store.text_buffers(batch.column(text_column))
            words, hashes = _words(raw, bounds)
            starts, sizes, docs, items = _search(words, hashes, bench, window, gram)
            change = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + sizes, -1)
            named: list[set[str]] = [set() for _ in range(len(bounds) - 1)]
            if len(docs):
                for d, i in np.unique(np.stack([docs, items], axis=1), axis=0):
                    named[d].add(bench.names[i])
            kept = {c: batch.column(c) for c in keep}
            yield _result(batch.column("key"), words, np.cumsum(change)[:-1] > 0, [sorted(s) for s in named], kept)

    return run


def _merge(rows: pa.Table) -> pa.Table:
    """One document's results for several benchmark blocks as one row."""
    parts = rows.to_pylist()
    spans: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for p in parts for s in p["spans"]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    row = {
        "key": parts[0]["key"],
        "n_words": parts[0]["n_words"],
        "n_hit": sum(e - s for s, e in spans),
        "spans": [{"start": s, "end": e} for s, e in spans],
        "items": sorted({i for p in parts for i in p["items"]}),
    }
    return pa.Table.from_pylist([row], schema=_ARROW)


def _parse(ddl: str) -> list:
    return list(StructType.fromDDL(ddl))


def benchmark_blocks(items: DataFrame, window: int, gram: int, block_bytes: int) -> Iterator[BenchmarkBlock]:
    """Items (name, text) in parts of at most ``block_bytes`` of text (or one item), fetched one by one."""
    names, texts, size = [], [], 0
    for row in items.toLocalIterator():
        names.append(row["name"])
        texts.append(row["text"] or "")
        size += len(texts[-1])
        if size >= block_bytes:
            yield BenchmarkBlock(names, texts, window, gram)
            names, texts, size = [], [], 0
    if names:
        yield BenchmarkBlock(names, texts, window, gram)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 10,
    gram: int = 5,
    benchmark_block_bytes: int = 4 << 20,
    batch_bytes: int = 2 << 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: ``id_column``, ``n_words``, ``n_hit``, ``spans`` of hit words, the names of the ``items`` found, and ``keep``.

    Words are runs of digits, letters a-z (A-Z are lower-cased) and non-ASCII characters.
    An item of fewer than ``window`` words is one window; one without words is never found.
    A null text has no words; a document without hits has empty lists. Repeated rows each
    give a row, a null id stays null, an item without id is called ``null``, and equal item
    ids count once. An empty benchmark hits nothing. Columns not named are not read; those in
    ``keep`` must not be called like the result's own, ``key`` or ``row__``.

    Only parts of the benchmark of bounded size are broadcast. A larger benchmark is
    searched part by part, and the parts' results are merged per document.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("name"), F.col(item_text_column).alias("text")
    )
    blocks = [spark.sparkContext.broadcast(b) for b in benchmark_blocks(items, window, gram, benchmark_block_bytes)]
    if not blocks:
        blocks = [spark.sparkContext.broadcast(BenchmarkBlock([], [], window, gram))]
    kept = [c for c in keep if c != text_column]
    texts = docs.select(F.col(id_column).cast("long").alias("key"), text_column, *kept)
    schema = StructType([*_parse(_SCHEMA), *[texts.schema[c] for c in keep]])
    if len(blocks) == 1:
        return texts.mapInArrow(_scan(blocks[0], window, gram, batch_bytes, text_column, keep), schema).withColumnRenamed("key", id_column)
    # Rows get a number that stays the same in each pass, as ids may be null or repeated.
    numbered = store.materialise(texts.withColumn("row__", F.monotonically_increasing_id()), "numbered")
    by_row = numbered.select(F.col("row__").alias("key"), text_column)
    passes = [by_row.mapInArrow(_scan(b, window, gram, batch_bytes, text_column, ()), _SCHEMA) for b in blocks]
    merged = functools.reduce(DataFrame.unionAll, passes).groupBy("key").applyInArrow(_merge, _SCHEMA)
    result = ["n_words", "n_hit", "spans", "items"]
    joined = numbered.join(merged.select(F.col("key").alias("row__"), *result), "row__")
    return joined.select(F.col("key").alias(id_column), *result, *keep)
