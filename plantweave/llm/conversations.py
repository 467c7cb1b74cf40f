"""Damage conversations in a reproducible way, find their faults, and repair their roles.

A conversation's rows are ordered by turn (null first), then by role and the MD5 of the text,
so equal rows stand together. All work up to the audit runs on rows without their texts, dealt
out by ranges of that order: a long conversation is cut into pieces of at most ``PIECE`` rows that
are solved apart, for each state they may begin and end in, and folded afterwards. Texts move
once, to be hashed in order behind their conversation's audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantweave.llm import store
from plantweave.llm.repair import ASSISTANT, EMPTY, SYSTEM, USER, WHOLE, Fold, Row, search

PIECE = 64
_BLANKS = " \t\n\x0b\x0c\r"
#: Pairs of neighbouring initials that are no fault.
_LEGAL = ("su", "ua", "au")
_ROLES = {"u": "user", "a": "assistant"}
_ORDER = ["conv", "has_turn", "turn", "role", "digest"]


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: (conv, has_turn, turn, role, text, copies); ``conv`` is the id in a struct, so null is a value."""
    text = _text(F.col("text"))
    kind = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn")))) % 20
    return conversations.withColumn("kind", kind).filter("kind <> 0").select(
        F.struct("conv_id").alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(_text(F.col("role"))).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faulted(rows: DataFrame) -> DataFrame:
    """Equal rows as one, without the text: the key columns, ``copies``, ``blank``, ``seen`` and ``truncated``.

    ``seen`` says that role and text stand at an earlier turn too. Of equal rows it means the first.
    """
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    blank, truncated = bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    keys = rows.withColumn("digest", F.md5("text")).withColumn("blank", blank).withColumn("cut", ~blank & truncated)
    one = keys.groupBy(*_ORDER, "blank", "cut").agg(F.sum("copies").alias("copies"))
    # Where a text that is not blank stands at several turns of a conversation, the first of them.
    several = one.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(
        F.min(F.struct("has_turn", "turn")).alias("first"), F.count("*").alias("n")
    )
    joined = one.join(several.filter("n > 1").drop("n"), ["conv", "role", "digest"], "left")
    seen = F.coalesce(~F.col("blank") & (F.struct("has_turn", "turn") > F.col("first")), F.lit(False))
    return joined.select(
        *_ORDER, "copies", "blank", seen.alias("seen"), (F.col("cut") & ~seen).alias("truncated")
    )


_PIECES = (
    "conv struct<conv_id: {id}>, part int, piece int, has_turn boolean, turn long, role string, digest string, "
    "first string, last string, illegal long, paths array<struct<entry: int, end: int, cost: long, audit: string>>"
)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema


def _solve(rows: list[dict], whole: bool) -> dict:
    """One piece of a conversation: its first key, neighbours at fault, and the best edits through it."""
    units = [Row(r["role"][:1], r["blank"] or r["seen"], r["truncated"], r["copies"] - 1) for r in rows]
    pairs = zip(units[:-1], units[1:])
    states = (EMPTY, SYSTEM, USER, ASSISTANT)
    ends = [(EMPTY, WHOLE)] if whole else [(a, b) for a in states for b in states]
    found = [(a, b, search(units, a, b)) for a, b in ends]
    return {
        **{c: rows[0][c] for c in _ORDER},
        "first": units[0].initial,
        "last": units[-1].initial,
        "illegal": sum(u.more for u in units) + sum(a.initial + b.initial not in _LEGAL for a, b in pairs),
        "paths": [{"entry": a, "end": b, "cost": f[0], "audit": f[1]} for a, b, f in found if f],
    }


def pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Rows of ``faulted`` as pieces of at most ``size`` rows of one conversation, in order (part, piece).

    The first and the last conversation of a range may go on in the next one. All others are
    known to be whole, and if they are no longer than a piece, one search ends them.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(store.partitions(spark), *_ORDER).sortWithinPartitions(*_ORDER)
    schema = _PIECES.format(id=rows.schema["conv"].dataType["conv_id"].dataType.simpleString())
    arrow = _arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, held, begun = TaskContext.get().partitionId(), 0, [], [], False

        def flush(whole: bool) -> None:
            nonlocal number, held
            out.append({**_solve(held, whole), "part": part, "piece": number})
            number, held = number + 1, []

        inside = False  # the conversation at hand is not the range's first and has not been cut
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["conv"] != row["conv"]:
                    flush(inside)
                    inside = True
                elif len(held) == size:
                    flush(False)
                    inside = False
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if held:
            flush(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return placed.mapInArrow(run, schema)


_EVENTS = (
    "conv struct<conv_id: {id}>, closing boolean, has_turn boolean, turn long, role string, digest string, "
    "audit string, cost long, illegal long"
)


def audits(found: DataFrame) -> DataFrame:
    """Pieces to the audit's parts, each at its piece's first key, and a closing row per conversation.

    The closing row holds the letters of the inserts at the end, the cost and the neighbours at fault.
    """
    spark = found.sparkSession
    placed = found.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    schema = _EVENTS.format(id=found.schema["conv"].dataType["conv_id"].dataType.simpleString())
    arrow = _arrow(spark, schema)

    def part_of(piece: dict, audit: str) -> dict:
        return {**{c: piece[c] for c in _ORDER}, "closing": False, "audit": audit, "cost": None, "illegal": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, fold, cost, illegal, last, out = None, None, 0, 0, None, []

        def close() -> None:
            end = ""
            if fold:
                total, end, left = fold.close()
                out.extend(part_of(piece, audit) for piece, audit in left)
            else:
                total = cost
            out.append({**dict.fromkeys(_ORDER), "conv": conv, "closing": True, "audit": end, "cost": total, "illegal": illegal})

        for batch in batches:
            for piece in batch.to_pylist():
                if piece["conv"] != conv:
                    if conv is not None:
                        close()
                    conv, fold, illegal, last = piece["conv"], None, 0, None
                illegal += piece["illegal"] + (last is not None and last + piece["first"] not in _LEGAL)
                last = piece["last"]
                paths = {(p["entry"], p["end"]): (p["cost"], p["audit"]) for p in piece["paths"]}
                if (EMPTY, WHOLE) in paths:
                    cost, audit = paths[EMPTY, WHOLE]
                    out.append(part_of(piece, audit))
                else:
                    fold = fold or Fold()
                    key = {c: piece[c] for c in _ORDER}
                    out.extend(part_of(at, audit) for at, audit in fold.add(key, paths))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        if conv is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return placed.mapInArrow(run, schema)


class _Repaired:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self):
        self.letters, self.at, self.audit = "", 0, []
        self.hash, self.rows, self.last = hashlib.sha256(), 0, ""

    def read(self, audit: str) -> None:
        self.letters, self.at = self.letters[self.at :] + audit, 0
        self.audit.append(audit)

    def _write(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.rows else "").encode() + f"{role}:{text}".encode())
        self.rows, self.last = self.rows + 1, role[:1]

    def _due(self) -> str:
        return _ROLES["a" if self.last == "u" else "u"]

    def inserts(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self._write(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self._write(role if letter == "K" else self._due(), text)


_RESULT = "conv struct<conv_id: {id}>, cost long, illegal long, audit string, repaired_sha256 string"


def rebuilt(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Damaged rows and the audit's parts, merged in order: (conv, cost, illegal, audit, repaired_sha256).

    A conversation's digest is one hash over its rows in order, so one task reads it, as a stream.
    """
    spark = rows.sparkSession
    texts = rows.select(
        "conv", F.lit(False).alias("closing"), "has_turn", "turn", "role", F.md5("text").alias("digest"), F.lit(1).alias("tag"), "text", "copies"
    )
    none = {c: F.lit(None).cast("long").alias(c) for c in ("cost", "illegal", "copies")}
    texts = texts.select("*", F.lit(None).cast("string").alias("audit"), none["cost"], none["illegal"])
    parts = events.select("*", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("text"), none["copies"])
    order = ["conv", "closing", *_ORDER[1:], "tag"]
    placed = texts.unionByName(parts).repartition("conv").sortWithinPartitions(*order)
    placed = placed.select("conv", "closing", "role", "text", "copies", "audit", "cost", "illegal")
    schema = _RESULT.format(id=rows.schema["conv"].dataType["conv_id"].dataType.simpleString())
    arrow = _arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = _Repaired(), []
        for batch in store.slices(batches, "text", 4 << 20):
            for row in batch.to_pylist():
                if row["audit"] is None:
                    for _ in range(row["copies"]):
                        own.row(row["role"], row["text"])
                    continue
                own.read(row["audit"])
                if row["closing"]:
                    own.inserts()
                    out.append({**{c: row[c] for c in ("conv", "cost", "illegal")}, "audit": "".join(own.audit), "repaired_sha256": own.hash.hexdigest()})
                    own = _Repaired()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []

    return placed.mapInArrow(run, schema)


def repair_conversations(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per ``conv_id`` (null is one, too): faults after damage, and the cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Nulls in
    id, turn, role and text read as one space (a null turn is no turn for ``gaps`` and comes first).
    Rows of one turn are ordered by role and the MD5 of the text. Equal rows are damaged alike, and all
    but the first of them are duplicates. A role without a first character cannot be kept. Texts of any
    length take part whole; an empty table gives no rows, a conversation whose rows are all dropped
    zeros, an empty audit and the hash of nothing. Columns beside conv_id, turn, role and text are
    not read, so their names do not matter.
    """
    own = conversations.select("conv_id", "turn", "role", "text")
    rows = damaged(own)
    found = store.materialise(faulted(rows), "conversation-faults")
    events = store.materialise(audits(pieces(found, piece)), "conversation-audits")
    by_turn = found.groupBy("conv", "has_turn", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    turn = F.when(F.col("has_turn"), F.col("turn"))
    counts = by_turn.groupBy("conv").agg(
        (F.max(turn) - F.min(turn) + 1 - F.count(turn)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    ids = own.select(F.struct("conv_id").alias("conv")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.join(counts, "conv", "left").join(rebuilt(rows, events), "conv", "left").select(
        "conv.conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
