"""N-gram Jaccard join: rare-first prefix filtering, each pair verified once.

Documents are sets of word shingles. Documents with the same set form a class, and only
one document of each class goes on. Shingles are ordered rare first, by counts over the
whole corpus kept in a sketch of fixed size (ties by hash). Two sets that are similar
enough share a shingle in their prefixes, so only prefix shingles are sent to shards of
the hash space, where length and positional filters leave the candidate pairs. Blocks of
documents then get the candidates' texts, a suffix filter rules more pairs out, and the
rest are intersected in full.

What must be right is which documents are connected. A shingle that a few documents share
gives all their pairs. One that many share (a large group of near copies) gives pairs with
one of them per class of sizes, the same for all shingles where it has them. Where such a
group then falls into several components, rounds look at pairs between components only: each
document with a few others of like size, with more of them, with all that are left. A round
begins with the components that the one before has found, so no pair is looked at whose
ends are connected already, and none is left out otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.llm import store
from plantweave.llm.components import components
from plantweave.llm.words import NOT_BLANK, Words, cut_sorted, mix, runs

_PAIRS = pa.schema([("block", pa.int64()), ("mine", pa.binary()), ("other", pa.binary())])
_PAIRS_DDL = "block long, mine binary, other binary"
_DOC_BITS = 20  # a node is block << 20 | place of the document in its block
_PLACE = (1 << _DOC_BITS) - 1


def _least_overlap(total: np.ndarray | int, percent: int):
    """Least intersection of two sets with ``total`` elements in all: 100 * i >= percent * (total - i)."""
    return -(-percent * total // (100 + percent))


class _Sets:
    """Distinct shingle hashes of each document, sorted by document and hash."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, size: int):
        words = Words(raw, bounds, NOT_BLANK)
        hashes = words.hashes()
        at = words.run_starts(size)
        doc, grams = [words.doc[at]], [runs(hashes, size)[at]]
        for n in range(1, size):  # short texts are one shingle each
            short = np.flatnonzero(words.counts == n)
            if len(short):
                doc.append(short)
                grams.append(runs(hashes, n)[words.first[short]])
        doc, grams = np.concatenate(doc), np.concatenate(grams)
        if len(doc) > len(at):
            order = np.argsort(doc, kind="stable")
            doc, grams = doc[order], grams[order]
        cuts = np.searchsorted(doc, np.arange(len(bounds)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            grams[a:b].sort()
        keep = np.r_[True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])] if len(doc) else np.zeros(0, bool)
        self.doc, self.grams = doc[keep], grams[keep]
        self.first = np.searchsorted(self.doc, np.arange(len(bounds)))
        self.counts = np.diff(self.first)

    def of(self, i: int) -> np.ndarray:
        return self.grams[self.first[i] : self.first[i + 1]]


def _block_sets(row: dict, size: int) -> tuple[store.Block, _Sets]:
    block = store.Block(row)
    return block, _Sets(block.raw, block.bounds, size)


def _signatures(size: int):
    """Per document of a block: place, id, set size and a 128-bit signature of the set."""
    schema = pa.schema(
        [("block", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, sets = _block_sets(row, size)
                sums = []
                for salt in (0x51ED270B, 0xA0761D65):
                    total = np.zeros(len(sets.grams) + 1, dtype=np.uint64)
                    np.cumsum(mix(sets.grams + np.uint64(salt)), out=total[1:])
                    sums.append(mix(total[sets.first[1:]] - total[sets.first[:-1]] + sets.counts.astype(np.uint64)).view(np.int64))
                n = len(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, block.number), pa.int64()),
                        pa.array(np.arange(n), pa.int32()),
                        pa.array(block.ids, pa.int64(), mask=block.missing),
                        pa.array(sets.counts, pa.int64()),
                        pa.array(sums[0], pa.int64()),
                        pa.array(sums[1], pa.int64()),
                    ],
                    schema=schema,
                )

    return run


def _keep_places(block: pa.Table, places: pa.Table) -> pa.Table:
    """The block with only the documents at these places, which stand instead of their ids."""
    if not block.num_rows or not places.num_rows:
        return pa.Table.from_pylist([], schema=store.BLOCK_ARROW)
    old = store.Block(block.to_pylist()[0])
    keep = np.sort(np.asarray(places.column("place"), dtype=np.int64))
    texts = b"".join(old.text(i) for i in keep)
    row = store.block_row(old.number, keep, keep < 0, np.diff(old.bounds)[keep], texts)
    return pa.Table.from_pylist([row], schema=store.BLOCK_ARROW)


_PARTS = 64


def _count_shingles(size: int, bits: int):
    """Per task: the sketch's counters, in parts."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, sets = _block_sets(row, size)
                counts += np.bincount((sets.grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.any():
            rows = [{"part": i, "counts": c.tobytes()} for i, c in enumerate(np.split(counts, _PARTS))]
            yield store.rows_batch(rows, schema)

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in table.column("counts").to_pylist())
    return pa.Table.from_pylist([{"part": table.column("part")[0].as_py(), "counts": total.tobytes()}], schema=table.schema)


def shingle_counts(blocks: DataFrame, size: int, bits: int) -> np.ndarray:
    """Counters of all shingles, by the upper bits of their hashes: 2 ** bits numbers, whatever the corpus."""
    parts = (
        blocks.mapInArrow(_count_shingles(size, bits), "part int, counts binary")
        .groupBy("part")
        .applyInArrow(_add_counts, "part int, counts binary")
    )
    counts = np.zeros((_PARTS, (1 << bits) // _PARTS), dtype=np.int64)
    for row in parts.collect():
        counts[row["part"]] = np.frombuffer(bytes(row["counts"]), dtype=np.int64)
    return np.minimum(counts.ravel(), 2**31 - 1).astype(np.int32)


def _prefixes(size: int, percent: int, counts, bits: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("grams", pa.binary()), ("rest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for row in batch.to_pylist():
                block, sets = _block_sets(row, size)
                rank = often[(sets.grams >> np.uint64(64 - bits)).astype(np.int64)]
                # Rare first within each document, ties by hash: sets.grams is sorted.
                key = (rank.astype(np.uint64) << np.uint64(32)) | np.arange(len(rank), dtype=np.uint64)
                for a, b in zip(sets.first[:-1], sets.first[1:]):
                    key[a:b].sort()
                order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                pos = np.arange(len(order)) - sets.first[sets.doc]
                n = sets.counts[sets.doc]
                head = pos < n + percent * -n // 100 + 1  # n - ceil(percent * n / 100) + 1
                grams, doc, pos, n = sets.grams[order][head], sets.doc[head], pos[head], n[head]
                order = np.argsort(grams, kind="stable")
                grams = grams[order]
                rest = np.stack([(block.number << _DOC_BITS) + block.ids[doc[order]], (n[order] << 32) + pos[order]], axis=1)
                cuts = cut_sorted(grams, shards)
                out = [
                    {"shard": k, "grams": grams[a:b].tobytes(), "rest": rest[a:b].tobytes()}
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
                    if b > a
                ]
                yield store.rows_batch(out, schema)

    return run


def _possible(n_a, pos_a, n_b, pos_b, percent: int) -> np.ndarray:
    """Length and positional filter for pairs that share a shingle at these positions."""
    length = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return length & (np.minimum(n_a - pos_a, n_b - pos_b) >= _least_overlap(n_a + n_b, percent))


def _keyed_rows(mine: np.ndarray, other: np.ndarray) -> list[dict]:
    """Pairs of nodes, each once, keyed by the block of the first, which will ask for the other."""
    pairs = np.unique(np.stack([mine, other], axis=1)[mine != other], axis=0)
    mine, other = pairs[:, 0], pairs[:, 1]
    blocks = mine >> _DOC_BITS
    cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
    return [
        {"block": int(blocks[s]), "mine": mine[s:e].tobytes(), "other": other[s:e].tobytes()}
        for s, e in zip(cuts, [*cuts[1:], len(blocks)])
    ]


def _pair_rows(a: np.ndarray, b: np.ndarray) -> list[dict]:
    """Pairs of nodes, each once, keyed by the node with fewer pairs here, of two alike by the larger.

    One document against many is so asked for by each of them, and does not ask for them all.
    """
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([hi, lo], axis=1)[hi != lo], axis=0)
    _, place, times = np.unique(pairs, return_inverse=True, return_counts=True)
    times = times[place.reshape(-1)].reshape(-1, 2)
    turned = times[:, 0] > times[:, 1]
    return _keyed_rows(np.where(turned, pairs[:, 1], pairs[:, 0]), np.where(turned, pairs[:, 0], pairs[:, 1]))


def _read_shard(table: pa.Table):
    grams = np.concatenate([np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()])
    rest = np.concatenate([np.frombuffer(r, dtype=np.int64) for r in table.column("rest").to_pylist()]).reshape(-1, 2)
    order = np.argsort(grams, kind="stable")
    grams, rest = grams[order], rest[order]
    heads = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams, rest[:, 0], rest[:, 1] >> 32, rest[:, 1] & 0xFFFFFFFF, heads, np.diff(np.r_[heads, len(grams)])


def _within(heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within groups of these sizes, which are small."""
    left, right = [], []
    for m in np.unique(sizes):
        i, j = np.triu_indices(m, 1)
        base = heads[sizes == m][:, None]
        left.append((base + i).ravel())
        right.append((base + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _candidates(percent: int, few: int):
    """First round: all pairs of small groups; for large ones pairs with one document per class of sizes."""
    schema = pa.schema([*_PAIRS, ("grams", pa.binary()), ("rest", pa.binary()), ("groups", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        grams, node, n, pos, heads, sizes = _read_shard(table)
        small = (sizes > 1) & (sizes <= few)
        i, j = _within(heads[small], sizes[small])
        large = np.flatnonzero(sizes > few)
        members = np.concatenate([np.arange(heads[g], heads[g] + sizes[g]) for g in large]) if len(large) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(large)), sizes[large])
        # One document per class of sizes, by one order for all shingles, so a group has few such documents.
        step = (np.log(np.maximum(n[members], 1)) / np.log(100 / min(percent, 99))).astype(np.int64)
        order = np.lexsort((mix(node[members].astype(np.uint64)), step, owner))
        members, owner, step = members[order], owner[order], step[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (step[1:] != step[:-1])][: len(members)]
        pivot = members[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(members) else members
        ok = _possible(n[i], pos[i], n[j], pos[j], percent)
        i, j = np.maximum(node[i[ok]], node[j[ok]]), np.minimum(node[i[ok]], node[j[ok]])
        ok = _possible(n[pivot], pos[pivot], n[members], pos[members], percent)
        # Each member asks for the one document: its block would else ask for the whole group.
        rows = _keyed_rows(np.r_[i, node[members[ok]]], np.r_[j, node[pivot[ok]]])
        rest = np.stack([node[members], (n[members] << 32) + pos[members]], axis=1)
        if len(large):
            rows.append({"block": None, "grams": grams[members].tobytes(), "rest": rest.tobytes(), "groups": len(large)})
        return pa.Table.from_pylist(rows, schema=schema)

    return run


_ASKED_DDL = "block long, mine binary, other binary, asker long, wanted long"


def _request(pairs_table: pa.Table) -> pa.Table:
    """One block's candidate pairs, each once, to the blocks that have the other documents."""
    schema = pa.schema([*_PAIRS, ("asker", pa.int64()), ("wanted", pa.int64())])
    block = pairs_table.column("block")[0].as_py()
    mine = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pairs_table.column("mine").to_pylist()])
    other = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pairs_table.column("other").to_pylist()])
    pairs = np.unique(np.stack([other, mine], axis=1), axis=0)
    other, mine = pairs[:, 0], pairs[:, 1]
    homes = other >> _DOC_BITS
    cuts = np.flatnonzero(np.r_[True, homes[1:] != homes[:-1]])
    rows = [
        {
            "block": int(homes[s]),
            "mine": mine[s:e].tobytes(),
            "other": other[s:e].tobytes(),
            "asker": block,
            "wanted": len(np.unique(other[s:e])),
        }
        for s, e in zip(cuts, [*cuts[1:], len(homes)])
    ]
    return pa.Table.from_pylist(rows, schema=schema)


def _text_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of a block's longest document and of all its documents."""
    for batch in batches:
        lengths = [np.frombuffer(x, dtype=np.int64) for x in batch.column("lengths").to_pylist()]
        sizes = [pa.array([int(f(x)) if len(x) else 0 for x in lengths], pa.int64()) for f in (np.max, np.sum)]
        yield pa.RecordBatch.from_arrays([batch.column("block"), *sizes], names=["block", "longest", "total"])


_TEXTS = pa.schema(
    [
        ("block", pa.int64()),
        ("home", pa.int64()),
        ("size", pa.int64()),
        ("mine", pa.binary()),
        ("other", pa.binary()),
        ("ids", pa.binary()),
        ("lengths", pa.binary()),
        ("texts", pa.binary()),
    ]
)
_TEXTS_DDL = "block long, home long, size long, mine binary, other binary, ids binary, lengths binary, texts binary"


def _send_texts(block: pa.Table, asked: pa.Table) -> pa.Table:
    rows = []
    if block.num_rows and asked.num_rows:
        docs = store.Block(block.to_pylist()[0])
        for r in asked.to_pylist():
            nodes = np.unique(np.frombuffer(r["other"], dtype=np.int64))
            texts = [docs.text(int(i)) for i in np.searchsorted(docs.ids, nodes & _PLACE)]
            lengths = np.array([len(t) for t in texts])
            packed = store.block_row(0, nodes, nodes < 0, lengths, b"".join(texts))
            sent = {k: packed[k] for k in ("ids", "lengths", "texts")}
            rows.append({"block": r["asker"], "home": docs.number, "size": int(lengths.sum()) + 2 * len(r["mine"]), "mine": r["mine"], "other": r["other"], **sent})
    return pa.Table.from_pylist(rows, schema=_TEXTS)


def _in_parts(rows: DataFrame, size: str, by: str, bound: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``part``, so that a (block, part) has about ``bound`` bytes; and the parts of each block."""
    parts = store.materialise(
        rows.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / bound)).cast("int").alias("parts")), name
    )
    dealt = rows.join(parts, "block").withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).drop("parts")
    return dealt, parts


def _copies(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """A block once for each of its parts; blocks without one are left out."""
    return blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of an intersection: both sets cut at the same hashes, the smaller part of each cut."""
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    parts_a = np.diff(np.r_[0, np.searchsorted(a, cuts), len(a)])
    parts_b = np.diff(np.r_[0, np.searchsorted(b, cuts), len(b)])
    return int(np.minimum(parts_a, parts_b).sum())


class _Joined(dict):
    """Nodes that are connected so far, each with a parent."""

    def root(self, node: int) -> int:
        while (up := self.get(node, node)) != node:
            self[node] = self.get(up, up)
            node = up
        return node


def _verify(size: int, percent: int):
    """Links of a task's pairs that connect what its earlier links do not: at most one fewer than its documents."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(block: pa.Table, inbox: pa.Table) -> pa.Table:
        links, joined = [], _Joined()
        if block.num_rows and inbox.num_rows:
            docs, own = _block_sets(block.to_pylist()[0], size)
            for r in inbox.to_pylist():
                mine = np.frombuffer(r["mine"], dtype=np.int64)
                other = np.frombuffer(r["other"], dtype=np.int64)
                here = np.searchsorted(docs.ids, mine & _PLACE)
                sent = store.Block({"block": 0, "ids": r["ids"], "missing": b"", "lengths": r["lengths"], "texts": r["texts"]})
                sets = _Sets(sent.raw, sent.bounds, size)
                for k, there in enumerate(np.searchsorted(sent.ids, other)):
                    x, y = joined.root(int(other[k])), joined.root(int(mine[k]))
                    if x == y:
                        continue
                    a, b = own.of(here[k]), sets.of(there)
                    least = _least_overlap(len(a) + len(b), percent)
                    if min(len(a), len(b)) < least or _suffix_bound(a, b) < least:
                        continue
                    # Both are sorted and distinct: equal neighbours are the intersection.
                    both = np.concatenate([a, b])
                    both.sort(kind="stable")
                    if int((both[1:] == both[:-1]).sum()) >= least:
                        links.append({"a": int(other[k]), "b": int(mine[k])})
                        joined[x] = y
        return pa.Table.from_pylist(links, schema=schema)

    return run


def _verified(blocks: DataFrame, pairs: DataFrame, size: int, percent: int, bound: int) -> DataFrame:
    """Candidate pairs (rows of arrays per block) to links (a, b); a task gets texts of about ``bound`` bytes at once."""
    asked = store.materialise(pairs.groupBy("block").applyInArrow(_request, _ASKED_DDL), "join-requests")
    sizes = blocks.select("block", "lengths").mapInArrow(_text_sizes, "block long, longest long, total long")
    most = F.least(F.col("wanted") * F.col("longest"), F.col("total")) + 2 * F.octet_length("mine")
    asked = asked.join(sizes, "block").withColumn("most", most).drop("longest", "total")
    asked, parts = _in_parts(asked, "most", "asker", bound, "join-asked-parts")
    inbox = store.materialise(
        _copies(blocks, parts)
        .groupBy("block", "part")
        .cogroup(asked.groupBy("block", "part"))
        .applyInArrow(_send_texts, _TEXTS_DDL),
        "join-texts",
    )
    inbox, parts = _in_parts(inbox, "size", "home", bound, "join-inbox-parts")
    return store.materialise(
        _copies(blocks, parts)
        .groupBy("block", "part")
        .cogroup(inbox.groupBy("block", "part"))
        .applyInArrow(_verify(size, percent), "a long, b long"),
        "join-links",
    )


def _unpack_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            grams = np.frombuffer(row["grams"], dtype=np.int64)
            rest = np.frombuffer(row["rest"], dtype=np.int64).reshape(-1, 2)
            columns = [grams, rest[:, 0], rest[:, 1] >> 32, rest[:, 1] & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=schema)


#: Distances in a large group's order by set size; each round forms pairs of one stretch of them.
_ROUNDS = ((1, 9), (9, 65), (65, None))
#: Pairs that are filtered at once.
_PIECE = 1 << 18


def _across(percent: int, near: int, far: int | None):
    """Pairs of a group's documents that lie in different components, after the filters.

    The group is ordered by set size; a pair's documents are at least ``near`` and less than ``far``
    places apart. The order does not depend on the components, so each pair is formed in one round.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root, n, pos = (np.asarray(table.column(c), dtype=np.int64) for c in ("node", "root", "n", "pos"))
        order = np.lexsort((mix(node.astype(np.uint64)), n))
        node, root, n, pos = node[order], root[order], n[order], pos[order]
        rows, place = [], np.arange(len(node))

        def add(i: np.ndarray, j: np.ndarray) -> None:
            ok = root[i] != root[j]
            i, j = i[ok], j[ok]
            ok = _possible(n[i], pos[i], n[j], pos[j], percent)
            rows.extend(_pair_rows(node[i[ok]], node[j[ok]]))

        if far:
            steps = range(near, min(far, len(node)))
            if steps:
                add(np.concatenate([place[:-d] for d in steps]), np.concatenate([place[d:] for d in steps]))
        else:
            # All but the largest component against all others, within reach of the length filter.
            _, own, sizes = np.unique(root, return_inverse=True, return_counts=True)
            inside, held, many = own == np.argmax(sizes), [], 0
            for i in np.flatnonzero(~inside):
                a, b = np.searchsorted(n, [-(-percent * n[i] // 100), 100 * n[i] // percent + 1])
                j = place[a:b]
                # Of two documents outside the largest component, the earlier one brings the pair.
                j = j[(np.abs(j - i) >= near) & (inside[j] | (j > i))]
                held.append((np.full(len(j), i), j))
                many += len(j)
                if many >= _PIECE:
                    add(*map(np.concatenate, zip(*held)))
                    held, many = [], 0
            if held:
                add(*map(np.concatenate, zip(*held)))
        return pa.Table.from_pylist(rows, schema=_PAIRS)

    return run


def similar_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    percent: int = 80,
    block_bytes: int = 2 << 20,
    sketch_bits: int = 20,
    few: int = 8,
    inbox_bytes: int = 32 << 20,
) -> DataFrame:
    """Per document: ``id_column``, ``n_shingles`` (its set's size) and ``component_id``.

    Words are what stands between the six ASCII blanks, A-Z in lower case; a set holds the
    distinct runs of ``shingle`` words, or the whole text as one run if it is shorter. Two
    documents link if ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest id that links lead to, the document's own included. A null, empty or blank
    text has an empty set and links with nothing. Repeated rows each give a row and link
    with their copies. A null id stays null and is never a component id unless no member
    has another. Other columns are not read; an empty table gives no rows.

    ``few``, ``sketch_bits`` and ``inbox_bytes`` change the plan only, not the result.
    """
    spark = docs.sparkSession
    lowered = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    blocks = store.materialise(store.pack_blocks(lowered, block_bytes, False, lower=True), "join-blocks")
    members = store.materialise(
        blocks.mapInArrow(_signatures(shingle), "block long, place int, key long, n long, sig_a long, sig_b long"), "join-signatures"
    )
    # A document of each class stands for it.
    classes = store.materialise(
        members.filter("n > 0")
        .groupBy("sig_a", "sig_b")
        .agg(F.min(F.struct("block", "place")).alias("at"), F.min("key").alias("least"))
        .select("sig_a", "sig_b", "least", "at.block", "at.place"),
        "join-classes",
    )
    single = store.materialise(
        blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(_keep_places, store.BLOCK_SCHEMA),
        "join-representatives",
    )
    counts = spark.sparkContext.broadcast(shingle_counts(single, shingle, sketch_bits))
    shards = 4 * store.partitions(spark)
    found = store.materialise(
        single.mapInArrow(_prefixes(shingle, percent, counts, sketch_bits, shards), "shard int, grams binary, rest binary")
        .groupBy("shard")
        .applyInArrow(_candidates(percent, few), _PAIRS_DDL + ", grams binary, rest binary, groups int"),
        "join-candidates",
    )
    links = _verified(single, found.filter("block is not null").select("block", "mine", "other"), shingle, percent, inbox_bytes)
    shared = found.filter("block is null").select("grams", "rest").mapInArrow(_unpack_members, "gram long, node long, n long, pos long")
    roots = store.materialise(components(links), "join-roots")
    # Large groups whose documents are not all connected yet. Each round forms pairs that are
    # farther apart, of what is still unconnected, and adds its links to the roots known so far.
    for near, far in _ROUNDS:
        labelled = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_groups = labelled.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("gram")
        labelled = store.materialise(labelled.join(open_groups, "gram"), "join-open")
        more = store.materialise(labelled.groupBy("gram").applyInArrow(_across(percent, near, far), _PAIRS_DDL), "join-across")
        if not more.isEmpty():
            links = _verified(single, more, shingle, percent, inbox_bytes)
            roots = store.materialise(components(roots.toDF("a", "b").unionAll(links)), "join-roots")
        shared = labelled.drop("root")
    node = F.shiftleft("block", _DOC_BITS) + F.col("place")
    rooted = classes.select("sig_a", "sig_b", "least", node.alias("node")).join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("sig_a", "sig_b", "component_id")
    return members.join(labels, ["sig_a", "sig_b"], "left").select(
        F.col("key").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("key")).alias("component_id"),
    )
