"""Repeated-phrase automata: remove every passage that an earlier document already has.

1. Documents are packed into blocks, which are ranges of document ids.
2. Each block sends the hashes of its distinct windows to shards of the hash space. A
   shard confirms the windows that recur and tells the block that has a window first
   which later blocks have it too.
3. The first block joins neighbouring windows into passages and sends their text on.
4. Each later block compiles Aho-Corasick automata over the passages it received, and
   streams its documents through them (all that share a window's hash with a passage;
   the others have none). Words stand as single characters, so a match is
   one of whole words. The automata hold aligned pieces of the passages, seven words for
   windows of thirteen: each window holds one whole piece. A hit is extended along the
   passage, word by word, and counts if it covers a window.

A hash only nominates: what is removed was matched word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.llm import store
from plantweave.llm.words import NOT_BLANK, Words, cut_sorted, runs

_PASSAGES = pa.schema([("dest", pa.int64()), ("first_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary()))])
_RESULT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


class _Windows:
    """Windows of a block: hash, first word and the words themselves."""

    def __init__(self, block: store.Block, window: int):
        self.block, self.window = block, window
        self.words = Words(block.raw, block.bounds, NOT_BLANK)
        self.at = self.words.run_starts(window)
        hashes = runs(self.words.hashes(), window)
        self.hashes = hashes[self.at]

    def passages(self, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Windows at these words (sorted), neighbours joined: id of the document and text of each passage."""
        if not len(at):
            return np.zeros(0, np.int64), []
        doc = self.words.doc[at]
        new = np.r_[True, (np.diff(at) != 1) | (np.diff(doc) != 0)]
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:], len(at)] - 1
        starts = self.words.starts[at[heads]]
        ends = self.words.ends[at[tails] + self.window - 1]
        return self.block.ids[doc[heads]], [self.block.raw[s:e].tobytes() for s, e in zip(starts, ends)]

    def recurring_here(self) -> np.ndarray:
        """First word of each window that a later document of this block has too."""
        order = np.argsort(self.hashes, kind="stable")
        h, ids = self.hashes[order], self.block.ids[self.words.doc[self.at[order]]]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        tails = np.r_[heads[1:], len(h)] - 1 if len(h) else heads
        return np.sort(self.at[order[heads[ids[tails] > ids[heads]]]])


def _hash_windows(window: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes = np.unique(_Windows(store.Block(row), window).hashes)
                cuts = cut_sorted(hashes, shards)
                out = [
                    {"shard": k, "block": row["block"], "hashes": hashes[a:b].tobytes()}
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
                    if b > a
                ]
                yield store.rows_batch(out, schema)

    return run


def _confirm(table: pa.Table) -> pa.Table:
    """One shard: for each block, its windows that it has first and the later blocks that have them."""
    schema = pa.schema([("block", pa.int64()), ("hashes", pa.binary()), ("dests", pa.binary())])
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    parts = [np.frombuffer(r["hashes"], dtype=np.uint64) for r in rows]
    hashes = np.concatenate(parts)
    blocks = np.repeat(np.array([r["block"] for r in rows], dtype=np.int64), [len(p) for p in parts])
    del parts, rows
    order = np.argsort(hashes, kind="stable")
    hashes, blocks = hashes[order], blocks[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    later = np.flatnonzero(~new)
    first = blocks[np.flatnonzero(new)][(np.cumsum(new) - 1)[later]]
    hashes, dests = hashes[later], blocks[later]
    order = np.argsort(first, kind="stable")
    first, hashes, dests = first[order], hashes[order], dests[order]
    heads = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
    out = [
        {"block": int(first[a]), "hashes": hashes[a:b].tobytes(), "dests": dests[a:b].tobytes()}
        for a, b in zip(heads, np.r_[heads[1:], len(first)].astype(np.int64))
    ]
    return pa.Table.from_pylist(out, schema=schema)


def _send_passages(window: int):
    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows and wanted.num_rows:
            here = _Windows(store.Block(block.to_pylist()[0]), window)
            asked = wanted.to_pylist()
            hashes = np.concatenate([np.frombuffer(r["hashes"], dtype=np.uint64) for r in asked])
            dests = np.concatenate([np.frombuffer(r["dests"], dtype=np.int64) for r in asked])
            known, first = np.unique(here.hashes, return_index=True)
            at = here.at[first[np.searchsorted(known, hashes)]]
            order = np.lexsort((at, dests))
            at, dests = at[order], dests[order]
            heads = np.flatnonzero(np.r_[True, dests[1:] != dests[:-1]])
            for a, b in zip(heads, np.r_[heads[1:], len(dests)]):
                ids, texts = here.passages(at[a:b])
                rows.append({"dest": int(dests[a]), "first_ids": ids.tolist(), "texts": texts})
        return pa.Table.from_pylist(rows, schema=_PASSAGES)

    return run


def _same(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on agree, ``most`` at most."""
    n, step = 0, 32
    while n < most and step:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        else:
            step //= 2
    return n


class _Automaton:
    """Passages as strings of one character a word, and an automaton over their aligned pieces."""

    def __init__(self, passages: list[tuple[int, list[bytes]]], window: int):
        self.window, self.piece = window, (window + 1) // 2
        self.chars: dict[bytes, str] = {}
        self.first_ids = [p[0] for p in passages]
        self.strings = []
        find = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for n, (_, words) in enumerate(passages):
            chars = self.chars
            for w in words:
                if w not in chars:
                    code = len(chars) + 1
                    chars[w] = chr(code if code < 0xD800 else code + 0x800)  # no surrogates
            string = "".join([chars[w] for w in words])
            self.strings.append(string)
            for off in range(0, len(string) - self.piece + 1, self.piece):
                key = string[off : off + self.piece]
                have = find.get(key, None)
                if have is None:
                    find.add_word(key, [(n, off)])
                else:
                    have.append((n, off))
        find.make_automaton()
        self.find = find

    def mark(self, words: list[bytes], doc_id: int, covered: bytearray) -> None:
        """Set ``covered`` for the words inside passages of documents with smaller ids."""
        get = self.chars.get
        text = "".join([get(w, "\0") for w in words])
        done: dict[tuple[int, int], int] = {}
        piece, strings, first_ids = self.piece, self.strings, self.first_ids
        for end, places in self.find.iter(text):
            for n, off in places:
                if first_ids[n] >= doc_id:
                    continue
                shift = end - piece + 1 - off
                if done.get((n, shift), -1) >= end:
                    continue
                string = strings[n]
                lo = max(0, shift)
                hi = min(len(text), shift + len(string))
                if text[lo:hi] != string[lo - shift : hi - shift]:
                    right = end + 1 + _same(text, end + 1, string, end + 1 - shift, hi - end - 1)
                    left = end - piece + 1
                    while left > lo and text[left - 1] == string[left - 1 - shift]:
                        left -= 1
                    lo, hi = left, right
                done[n, shift] = hi - 1
                if hi - lo >= self.window:
                    covered[lo:hi] = b"\1" * (hi - lo)


def _automata(passages: list[tuple[int, bytes]], window: int, size: int) -> Iterator[_Automaton]:
    """Automata over at most about ``size`` words of passages each."""
    held, words = [], 0
    for first_id, text in passages:
        split = text.split()
        held.append((first_id, split))
        words += len(split)
        if words >= size:
            yield _Automaton(held, window)
            held, words = [], 0
    if held:
        yield _Automaton(held, window)


def _locate(window: int, size: int):
    def run(block: pa.Table, received: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.Table.from_pylist([], schema=_RESULT)
        docs = store.Block(block.to_pylist()[0])
        here = _Windows(docs, window)
        passages = list(zip(*here.passages(here.recurring_here())))
        passages += [(i, t) for r in received.to_pylist() for i, t in zip(r["first_ids"], r["texts"])]
        # A document that shares no window's hash with any passage has none of them.
        raw = b" ".join(t for _, t in passages)
        known = runs(Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), NOT_BLANK).hashes(), window)
        to_search = np.unique(here.words.doc[here.at[np.isin(here.hashes, known)]])
        del here, raw, known
        words = [docs.text(i).split() for i in range(len(docs))]
        covered = [bytearray(len(w)) for w in words]
        for automaton in _automata(passages, window, size):
            for i in to_search:
                automaton.mark(words[i], int(docs.ids[i]), covered[i])
        kept = [
            b" ".join([w for w, c in zip(ws, cs) if not c] if 1 in cs else ws).decode("utf-8", "replace")
            for ws, cs in zip(words, covered)
        ]
        return pa.table(
            [
                pa.array(docs.ids, pa.int64(), mask=docs.missing),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([c.count(1) for c in covered], pa.int64()),
                pa.array(kept, pa.string()),
            ],
            schema=_RESULT,
        )

    return run


def remove_repeated_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = 13,
    block_bytes: int = 2 << 20,
    automaton_words: int = 500_000,
) -> DataFrame:
    """Per document: ``id_column``, ``n_words``, ``n_removed`` and ``kept``, the words left, joined by blanks.

    A word goes if a window of ``window`` words around it also starts in a document with
    a smaller id; windows are judged on the input. Words are separated by the six ASCII
    blanks. A null or empty text has no words and an empty ``kept``. A null id counts as
    larger than all others, and rows with one id never remove words from one another.
    Other columns are not read, so clashing names do no harm; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = store.materialise(
        store.pack_blocks(docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text")), block_bytes, True),
        "phrase-blocks",
    )
    shards = 4 * store.partitions(spark)
    wanted = store.materialise(
        blocks.mapInArrow(_hash_windows(window, shards), "shard int, block long, hashes binary")
        .groupBy("shard")
        .applyInArrow(_confirm, "block long, hashes binary, dests binary"),
        "phrase-windows",
    )
    passages = store.materialise(
        blocks.groupBy("block")
        .cogroup(wanted.groupBy("block"))
        .applyInArrow(_send_passages(window), "dest long, first_ids array<long>, texts array<binary>"),
        "phrase-passages",
    )
    found = (
        blocks.groupBy("block")
        .cogroup(passages.groupBy("dest"))
        .applyInArrow(_locate(window, automaton_words), "key long, n_words long, n_removed long, kept string")
    )
    return found.withColumnRenamed("key", id_column)
