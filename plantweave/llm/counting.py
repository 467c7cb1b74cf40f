"""Edit-aware token counts.

A text is kept as parts that the tokenizer encodes independently, the leaves of a segment
tree with sums of characters and tokens. An edit finds its leaves by descending on the
character sums, encodes only them and the leaf before (where a part could grow together
with the edited one), and brings the sums on the paths to the root up to date.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.llm import store
from plantweave.llm.packing import Encoder, encoder


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, encode: Encoder, text: str):
        self.encoder = encode
        self.leaves, tokens = self._leaves(text)
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        # Sums per node, the root is 1. Typed arrays, since an edit reads and writes single entries.
        self.char_sums = self._sums([len(x) for x in self.leaves])
        self.token_sums = self._sums(tokens)
        self.encoded = 0  # tokens encoded again by edits

    def _sums(self, values: list[int]) -> array:
        sums = np.zeros(2 * self.size, dtype=np.int64)
        sums[self.size : self.size + len(values)] = values
        level = self.size
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2
        return array("q", sums.tobytes())

    def _leaves(self, text: str) -> tuple[list[str], list[int]]:
        head, *rest = self.encoder.parts(text)
        return [head, *(" " + p for p in rest)], self.encoder.counts(head, rest)

    @property
    def characters(self) -> int:
        return self.char_sums[1]

    @property
    def tokens(self) -> int:
        return self.token_sums[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character (the last one with text if there is none), and where the leaf starts."""
        at = max(0, min(at, self.characters - 1))
        node, start, sums = 1, 0, self.char_sums
        while node < self.size:
            node *= 2
            left = sums[node]
            if at >= left:
                at, start, node = at - left, start + left, node + 1
        return node - self.size, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` to ``end`` (cut to the text's length)."""
        start = max(0, min(start, self.characters))
        end = max(start, min(end, self.characters))
        first, at = self._find(start)
        if start <= at + 1 and at > 0:  # the part's beginning changes, so it may join the one before
            first, at = self._find(at - 1)
        last, _ = self._find(end)
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - at] + replacement + old[end - at :]
        if at > 0:  # the first leaf keeps its blank and the character after it
            parts = self.encoder.parts(new)[1:]
            leaves, tokens = [" " + p for p in parts], self.encoder.counts("", parts)[1:]
        else:
            leaves, tokens = self._leaves(new)
        self.encoded += sum(tokens)
        slots = last + 1 - first
        if len(leaves) > slots:  # more parts than leaves: the last leaf holds several
            leaves[slots - 1 :] = ["".join(leaves[slots - 1 :])]
            tokens[slots - 1 :] = [sum(tokens[slots - 1 :])]
        pad = slots - len(leaves)
        self.leaves[first : last + 1] = leaves + [""] * pad
        self._update(self.char_sums, first, last, [len(x) for x in leaves] + [0] * pad)
        self._update(self.token_sums, first, last, tokens + [0] * pad)

    def _update(self, sums: array, first: int, last: int, values: list[int]) -> None:
        """Set leaves and bring the sums above them up to date; where their paths have met, by the difference."""
        lo, hi = self.size + first, self.size + last
        grown = sum(values) - sum(sums[lo : hi + 1])
        sums[lo : hi + 1] = array("q", values)
        lo, hi = lo // 2, hi // 2
        while lo < hi:
            for node in range(lo, hi + 1):
                sums[node] = sums[2 * node] + sums[2 * node + 1]
            lo, hi = lo // 2, hi // 2
        while lo and grown:
            sums[lo] += grown
            lo //= 2


def count_edited(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    edits_column: str = "edits",
) -> DataFrame:
    """Per row: ``id_column``, ``n_tokens`` before, ``n_edited`` after all edits, ``n_edits``, ``n_encoded`` again and ``edited``, the new text.

    ``edits_column`` is an array of (start, end, replacement); each edit refers to the text
    that the earlier ones left, in code points. Positions beyond the text are cut to it, a null
    replacement is empty, a null edit or list is none. A null text is an empty one. Repeated
    rows each give a row, a null id stays null, other columns are not read.
    """
    schema = pa.schema(
        [("key", pa.int64()), ("n_tokens", pa.int64()), ("n_edited", pa.int64()), ("n_edits", pa.int64()), ("n_encoded", pa.int64()), ("edited", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in store.slices(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            edits = batch.column("edits")
            bounds = np.asarray(edits.offsets) - edits.offsets[0].as_py()
            starts, ends, replacements = (c.to_pylist() for c in edits.flatten().flatten())
            rows = []
            for text, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist()):
                if a == b:
                    n = len(own.ids(text)) // 4
                    rows.append((n, n, 0, 0, text))
                    continue
                tree = TokenTree(own, text)
                n = tree.tokens
                for edit in zip(starts[a:b], ends[a:b], replacements[a:b]):
                    tree.edit(*edit)
                rows.append((n, tree.tokens, b - a, tree.encoded, tree.text()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], schema=schema)

    rows = docs.select(
        F.col(id_column).cast("long").alias("key"),
        F.col(text_column).alias("text"),
        F.transform(
            F.filter(F.coalesce(F.col(edits_column), F.array()), lambda e: e.isNotNull()),
            lambda e: F.struct(
                F.coalesce(e["start"].cast("int"), F.lit(0)).alias("start"),
                F.coalesce(e["end"].cast("int"), F.lit(0)).alias("end"),
                F.coalesce(e["replacement"], F.lit("")).alias("replacement"),
            ),
        ).alias("edits"),
    )
    out = rows.mapInArrow(run, "key long, n_tokens long, n_edited long, n_edits long, n_encoded long, edited string")
    return out.withColumnRenamed("key", id_column)
