"""Best-fit packing with exact-complement hashing.

Documents become token pieces of at most the capacity. How the pieces are combined
depends only on how many there are of each length, a table of at most ``capacity`` rows,
so the plan is made from those counts: it looks up single lengths, pairs and triples whose
sums fill a gap exactly, consumes them while they last, and packs the rest best fit, longest
first. Pieces are then numbered within their length, and each number's place follows from
the plan; no piece leaves the cluster.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantweave.llm import store

_PIECES = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


# Fixed value: how a byte-level vocabulary cuts a text into the pieces that it merges.
_PIECES_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranked byte strings, if it merges in the order of its ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = _byte_of_char()
    vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [vocabulary.get(a + b) for a, b in merges]
    if model["type"] != "BPE" or order != list(range(256, 256 + len(order))):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(order)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The ids are those of the library ``tokenizers`` with the file. Texts of Latin letters
    only go through ``tiktoken`` over the same file's vocabulary, which merges alike and is
    several times as fast; other scripts, where the two libraries' tables of letters may
    differ in age, texts with huge runs of blanks and texts that hold the string of one of
    the file's added tokens go through ``tokenizers`` itself.
    """

    _OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = added and re.compile("|".join(map(re.escape, added)))
        # An added token ends a run of blanks before it. A text is never cut within such a run,
        # so no cut after a blank where one could begin, now or after an edit.
        firsts = "".join(sorted({re.escape(t[0]) for t in added}))
        self._part = re.compile(rf"(?<!\s) (?=\S)| (?=[^\s{firsts}])")
        self._blanks = re.compile(rf" (?:\s|\Z)|\s [{firsts}]" if added else r" (?:\s|\Z)")
        ranks = _ranks(path)
        self.fast = ranks and tiktoken.Encoding("own", pat_str=_PIECES_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.remembered = remembered
        self.known: dict[str, int] = {}

    def ids(self, text: str) -> bytes:
        huge = len(text) > 100_000 and re.search(r"\s{10000}", text)
        special = self.added and self.added.search(text)
        if self.fast is None or huge or special or not text.isascii() and self._OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def parts(self, text: str) -> list[str]:
        return self._part.split(text) if self._blanks.search(text) else text.split(" ")

    def counts(self, head: str, rest: list[str]) -> list[int]:
        """Tokens of a text's first part and of each further part with its blank.

        The tokenizer never merges across a blank before a non-blank, so these add up.
        """
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        for p in rest:
            if p not in known:
                known[p] = len(self.ids(" " + p)) // 4
        return [len(self.ids(head)) // 4 if head else 0, *(known[p] for p in rest)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so its memory serves all of the worker's tasks."""
    return Encoder(path)


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_bytes: int = 2 << 20,
) -> DataFrame:
    """Pieces of each document: ``id_column``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian 32-bit).

    A document is its ids and then ``end_id``. One longer than ``capacity`` is cut so that
    all pieces but the first have ``capacity`` ids. A null or empty text is just ``end_id``.
    Repeated rows each give their pieces, a null id stays null, other columns are not read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        for batch in store.slices(batches, "text", batch_bytes):
            keys, piece, start, ids = [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                own = encode(text or "") + end
                n = len(own) // 4
                at = 0
                stop = n % capacity or min(n, capacity)
                number = 0
                while at < n:
                    keys.append(key)
                    piece.append(number)
                    start.append(at)
                    ids.append(own[4 * at : 4 * stop])
                    at, stop, number = stop, stop + capacity, number + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                schema=_PIECES,
            )

    texts = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    pieces = texts.mapInArrow(run, "key long, piece int, start long, length long, ids binary")
    return pieces.withColumnRenamed("key", id_column)


class Complements:
    """Sums of one, two and three available lengths, looked up by the gap they must fill."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        size = len(counts)
        # Pairs a >= b by their sum; a sum of three is a length and a pair.
        self.pairs: list[np.ndarray] = [np.arange(s // 2 + s % 2, s) for s in range(size)]

    def _pair(self, gap: int, taken: dict[int, int]) -> tuple[int, int] | None:
        if gap < 2:
            return None
        a = self.pairs[gap]
        left = self.counts.copy()
        for length, n in taken.items():
            left[length] -= n
        ok = np.flatnonzero((left[a] > 0) & (left[gap - a] > (a == gap - a)))
        return (int(a[ok[-1]]), int(gap - a[ok[-1]])) if len(ok) else None

    def filling(self, length: int, parts: int) -> tuple[int, ...] | None:
        """That many available lengths (one to three) that fill up a sequence begun with ``length``."""
        gap = len(self.counts) - 1 - length
        if parts == 1:
            return (gap,) if gap and self.counts[gap] > (gap == length) else None
        if parts == 2:
            return self._pair(gap, {length: 1})
        for first in np.flatnonzero(self.counts[1 : max(1, gap - 1)])[::-1] + 1:
            first = int(first)
            if self.counts[first] > (first == length):
                taken = {length: 1}
                taken[first] = taken.get(first, 0) + 1
                pair = self._pair(gap - first, taken)
                if pair:
                    return (first, *pair)
        return None


def _plan(counts: np.ndarray, most_parts: int) -> list[tuple[tuple[int, ...], int]]:
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    index = Complements(left)
    for parts in range(1, most_parts + 1):
        for length in range(capacity - 1, 0, -1):
            while left[length]:
                rest = index.filling(length, parts)
                if rest is None:
                    break
                content = (length, *rest)
                uses = {x: content.count(x) for x in content}
                times = min(int(left[x]) // n for x, n in uses.items())
                for x, n in uses.items():
                    left[x] -= n * times
                plan.append((content, times))
    # Best fit for what no combination fills exactly, longest first.
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in opened if g >= length), default=None)
            if gap is None:
                each = capacity // length
                for content, times in (((length,) * each, n // each), ((length,) * (n % each), 1)):
                    if content and times:
                        opened.setdefault(capacity - length * len(content), []).append((content, times))
                n = 0
                continue
            content, times = opened[gap].pop()
            used = min(times, n)
            if times > used:
                opened[gap].append((content, times - used))
            if not opened[gap]:
                del opened[gap]
            opened.setdefault(gap - length, []).append((content + (length,), used))
            n -= used
    return plan + [x for group in opened.values() for x in group]


def plan_sequences(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences and how many there are of each; ``counts[n]``: pieces of length n.

    Single complements are used up first, then pairs, then triples. Triples and pairs also
    spend pieces that best fit could use well, so plans with and without them are made and
    the one with fewest sequences is taken. Each step uses up a length, so there are only
    some thousand steps, however many pieces.
    """
    plans = [_plan(counts, parts) for parts in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For numbers of pieces within a length, in order: length, first number, first sequence, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in plan:
        offset = 0
        for length in content:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


_LENGTH_SHIFT = 44  # a piece's number within its length stays below 2 ** 44


def pack_pieces(pieces: DataFrame, capacity: int = 1024, length_column: str = "length") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, without gaps from 0.

    Lengths must be from 1 to ``capacity``. All columns stay; columns named ``sequence_id``,
    ``offset``, ``task__`` or ``number__`` would clash and are refused. No rows give no rows.
    """
    clash = {"sequence_id", "offset", "task__", "number__"} & set(pieces.columns)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number pieces of each length within the task."""
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            lengths = np.asarray(batch.column(length_column), dtype=np.int64)
            if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= capacity:
                raise ValueError(f"piece lengths must be from 1 to {capacity}")
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            within = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            numbers = np.empty(len(order), dtype=np.int64)
            numbers[order] = within + seen[ordered]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(order), task), pa.int32()), pa.array(numbers)],
                names=[*batch.schema.names, "task__", "number__"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    numbered = store.materialise(pieces.mapInArrow(number, f"{ddl}, task__ int, number__ long"), "pieces")
    per_task = numbered.groupBy("task__", length_column).agg(F.count("*").alias("n__"))
    earlier = Window.partitionBy(length_column).orderBy("task__").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("task__", length_column, F.coalesce(F.sum("n__").over(earlier), F.lit(0)).alias("first__"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in per_task.groupBy(length_column).agg(F.sum("n__")).collect():
        counts[length] = n
    slots = numbered.sparkSession.sparkContext.broadcast(_slots(plan_sequences(counts)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = slots.value
        keys = (length << _LENGTH_SHIFT) + first
        for batch in batches:
            own = np.asarray(batch.column(length_column), dtype=np.int64)
            numbers = np.asarray(batch.column("number__"), dtype=np.int64) + np.asarray(batch.column("first__"), dtype=np.int64)
            at = np.searchsorted(keys, (own << _LENGTH_SHIFT) + numbers, side="right") - 1
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if not n.endswith("__")}
            columns |= {"sequence_id": pa.array(sequence[at] + numbers - first[at]), "offset": pa.array(offset[at])}
            yield pa.RecordBatch.from_pydict(columns)

    joined = numbered.join(firsts, ["task__", length_column]).select(*pieces.columns, "number__", "first__")
    return joined.mapInArrow(place, f"{ddl}, sequence_id long, offset long")
