"""Mix sources to target weights along a low-discrepancy schedule of equal-token blocks.

Every source is a line of its documents in a shuffled order, walked round and round, and cut into
blocks of ``block`` words. A source's target decides how many blocks it gives. The schedule has
a slot per point of the van der Corput sequence in base 2: slot i lies at the point whose binary
digits are those of i mirrored, and belongs to the source whose stretch of the cumulative number
of blocks holds the point. Slots of a source are ranked; the slot of rank r takes block r.

Nothing is looked up row by row. The slots of a source are the mirrored numbers of its
stretch, so they are made from the stretch, and a slot's rank is a sum over its binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantweave.llm import running, store

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its words.
MOST = 3
#: Slots of a source that one task makes in one go.
_STRETCH = 1 << 16
#: Up to so many sources their table goes to every task.
_FEW_SOURCES = 100_000
_SALTS = 64


def mirrored(numbers: np.ndarray, digits: int) -> np.ndarray:
    """The numbers with their lowest ``digits`` binary digits in reverse order."""
    out, rest = np.zeros_like(numbers), numbers.copy()
    for _ in range(digits):
        out = (out << 1) | (rest & 1)
        rest >>= 1
    return out


def points_below(slots: np.ndarray, limit: np.ndarray, digits: int) -> np.ndarray:
    """For each slot, how many slots before it have a point below ``limit`` (in units of 2 ** -digits).

    The slots before i are cut by the set digits of i: those that share the digits above a set
    one, have none there, and any digits below. Mirrored they are an arithmetic sequence.
    """
    out = np.zeros_like(slots)
    for d in range(digits):
        first = mirrored((slots >> (d + 1)) << (d + 1), digits)
        step = np.int64(1) << (digits - d)
        inside = np.clip((limit - first + step - 1) // step, 0, np.int64(1) << d)
        out += np.where((slots >> d) & 1, inside, 0)
    return out


def slots_of(begin: int, blocks: int, first: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, their ranks within the source) of up to ``_STRETCH`` numbers of a source's stretch."""
    numbers = np.arange(begin + first, begin + min(blocks, first + _STRETCH), dtype=np.int64)
    slots = mirrored(numbers, digits)
    return slots, points_below(slots, np.int64(begin + blocks), digits) - points_below(slots, np.int64(begin), digits)


def schedule_slots(sources: DataFrame, digits: int) -> DataFrame:
    """Sources (source_no, begin, blocks) to rows (source_no, slot, rank), one per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slots, ranks = slots_of(row["begin"], row["blocks"], row["first"], digits)
                number = pa.array(np.full(len(slots), row["source_no"], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([number, pa.array(slots), pa.array(ranks)], names=["source_no", "slot", "rank"])

    some = sources.filter("blocks > 0")
    parts = some.select(
        "source_no", "begin", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(_STRETCH).cast("long"))).alias("first")
    )
    # A source with many blocks is many rows here, each of them for any task.
    spread = parts.repartition(store.partitions(sources.sparkSession), "source_no", "first")
    return spread.mapInArrow(run, "source_no long, slot long, rank long")


def _capped(rest: int, weights: int) -> Column:
    """Whether a source stands above its limit when ``rest`` words are shared over ``weights``."""
    wide = lambda c: c.cast("decimal(38,0)")
    return wide(F.col("weight")) * F.lit(rest).cast("decimal(38,0)") > wide(F.col("source_size") * MOST) * F.lit(weights).cast("decimal(38,0)")


def with_targets(sources: DataFrame) -> DataFrame:
    """Sources (source_size, weight) with ``target``, the words that each shall give (a double).

    All words are shared by weight; what a source cannot take is shared again among the others
    until none is above its limit. Each round is one sum over the sources. The share for one unit
    of weight only grows, so a source above the limit once stays above it.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, weights = int(total or 0), int(weights or 0)
    whole, above = rest, -1
    while weights:
        over = _capped(rest, weights)
        n, taken, heavy = sources.filter(over).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if n == above:
            break
        above, rest = n, whole - MOST * int(taken or 0)
        weights = int(sources.agg(F.sum("weight")).first()[0]) - int(heavy or 0)
    if not weights:  # every source is at its limit
        return sources.withColumn("target", (F.col("source_size") * MOST).cast("double"))
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(weights).cast("double")
    return sources.withColumn("target", F.when(_capped(rest, weights), (F.col("source_size") * MOST).cast("double")).otherwise(share))


def _by_source(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """``docs`` with the columns of their source; a source with many documents meets several tasks."""
    if n_sources <= _FEW_SOURCES:
        return docs.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("source__"))).drop("source__")
    salted = sources.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
    own = docs.withColumn("own_salt", F.pmod(F.xxhash64("key", "size"), F.lit(_SALTS)).cast("int"))
    same = (F.col("own_salt") == F.col("salt")) & F.col("source").eqNullSafe(F.col("source__"))
    return own.join(salted, same).drop("source__", "salt", "own_salt")


class Mix:
    """A mix of ``docs`` by source: its documents with sources and targets, and its schedule.

    A document's size is its number of words; a null or empty text has none, is in no block and
    takes no part. A null source is a source, after all others. A null id is shuffled as an empty one;
    rows that repeat an id stand side by side in the shuffled order and count each for itself. A text of
    any length is cut at block ends. An empty table gives no rows, and one without any word targets
    of 0. Other columns, whatever their names, are not read.
    """

    def __init__(self, docs: DataFrame, block: int = 1024, seed: str = "mix", id_column: str = "doc_id",
                 text_column: str = "text", source_column: str = "source"):
        self.block = block
        text, doc_id = F.col(f"`{text_column}`"), F.col(f"`{id_column}`")
        words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
        sized = docs.select(doc_id.alias("doc_id"), F.col(f"`{source_column}`").alias("source"), words.alias("size"), key.alias("key"))
        sized = store.materialise(sized, "mix-sizes")
        sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        counted = {"source_no": F.lit(1), "words_before": F.col("source_size")}
        sources = running.sums_before(sources, [F.col("source").asc_nulls_last()], counted, "mix-sources")
        weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
        sources = with_targets(sources.withColumn("weight", weight.cast("long")))
        sources = sources.withColumn("words", F.floor("target").cast("long"))
        sources = sources.withColumn("blocks", F.expr(f"(words + {block - 1}) DIV {block}"))
        self.sources = running.sums_before(sources, [F.col("source_no").asc()], {"begin": F.col("blocks")}, "mix-targets")
        n_sources, blocks = self.sources.agg(F.count("*"), F.sum("blocks")).first()
        self.digits = max(0, int(blocks or 0) - 1).bit_length()
        names = self.sources.withColumnRenamed("source", "source__").drop("weight", "begin", "blocks")
        placed = _by_source(sized, names, n_sources)
        # One line of all documents, source after source; a document's place in its source is what is before it there.
        order = [F.col(c).asc() for c in ("source_no", "key", "size")]
        lined = running.sums_before(placed, order, {"place": F.col("size")}, "mix-documents")
        self.documents = lined.withColumn("place", F.col("place") - F.col("words_before")).drop("words_before", "key")

    def pieces(self) -> DataFrame:
        """The stretches of documents in the blocks: (source_no, place, doc_id, block, start, length).

        ``start`` is the stretch's first word in the document, ``place`` the document's place in its source.
        """
        rounds = F.sequence(F.lit(0).cast("long"), F.expr("(words - 1) DIV source_size"))
        walked = self.documents.filter("size > 0 AND words > 0").withColumn("round", F.explode(rounds))
        walked = walked.withColumn("at", F.col("round") * F.col("source_size") + F.col("place"))
        walked = walked.withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("words"))).filter("at < stop")
        number = lambda c: F.expr(f"{c} DIV {self.block}")
        cut = walked.withColumn("block", F.explode(F.sequence(number("at"), number("(stop - 1)"))))
        low, high = F.greatest("at", F.col("block") * self.block), F.least("stop", (F.col("block") + 1) * self.block)
        return cut.select("source_no", "place", "doc_id", "block", (low - F.col("at")).alias("start"), (high - low).alias("length"))

    def schedule(self) -> DataFrame:
        """Rows (slot, source_no, block, place, doc_id, start, length); sorted by slot they are the mix."""
        slots = schedule_slots(self.sources, self.digits).withColumnRenamed("rank", "block")
        return slots.join(self.pieces(), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """Rows (doc_id, source, size, source_size, target, taken), one per document."""
        sums = self.schedule().groupBy("source_no", "place").agg(F.sum("length").alias("taken"))
        columns = ["doc_id", "source", "size", "source_size", "target"]
        held = self.documents.filter("size > 0").join(sums, ["source_no", "place"], "left")
        held = held.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        return held.unionByName(self.documents.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each document (see ``Mix``)."""
    return Mix(docs, **options).taken()
