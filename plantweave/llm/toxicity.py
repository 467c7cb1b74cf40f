"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and beginnings of words (for inflected forms) learns from confirmed toxic texts and from texts
without a known label. Its risk is corrected by the share of toxic texts: unlabelled texts
count as clean, and the part that the toxic ones among them add is taken off again. Where
that correction would make the clean part of the risk negative, which is overfitting, the
step goes back up instead. The sample that training sees is bounded by parameters; the
share of toxic texts is counted over all labels, and every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plantweave.llm import store
from plantweave.llm.words import ALNUM, Words, mix


@dataclass(frozen=True)
class Training:
    """Bounds of the sample, and how training goes."""

    max_toxic: int = 6_000
    max_unlabelled: int = 12_000
    max_calibration: int = 6_000
    feature_bits: int = 18
    least_toxic_texts: int = 3
    least_contrast: float = 4.0
    steps: int = 150
    rate: float = 0.05
    decay: float = 1e-4
    tolerance: float = 0.0


#: Bytes from a word's start that are features of their own.
_BEGINNINGS = (4, 5, 6)


def _features(column: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted; a feature is the hash of a word or of its first bytes."""
    raw, bounds, _ = store.text_buffers(pc.utf8_lower(column))
    words = Words(raw, bounds, ALNUM)
    length = words.ends - words.starts
    keys = [(words.doc.astype(np.int64) << bits) | (words.hashes() >> np.uint64(64 - bits)).astype(np.int64)]
    for most in _BEGINNINGS:
        longer = length > most
        start = mix(words.hashes(most)[longer] + np.uint64(most))
        keys.append((words.doc[longer].astype(np.int64) << bits) | (start >> np.uint64(64 - bits)).astype(np.int64))
    keys = np.concatenate(keys)
    if wanted is not None:
        keys = keys[wanted[keys & ((1 << bits) - 1)]]
    keys = np.unique(keys)
    return keys >> bits, keys & ((1 << bits) - 1)


def _sample_features(bits: int):
    schema = pa.schema([("part", pa.string()), ("toxic", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches, "text", 1 << 20):
            doc, feature = _features(batch.column("text"), bits)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            own = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("toxic"), pa.array(own, pa.binary())], schema=schema)

    return run


class _Texts:
    """Texts as lists of feature numbers; sums of weights per text and the reverse."""

    def __init__(self, features: list[bytes], size: int):
        parts = [np.frombuffer(f, dtype=np.int32) for f in features]
        self.n, self.size = len(parts), size
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.text = np.repeat(np.arange(self.n), [len(p) for p in parts])

    def only(self, keep: np.ndarray) -> "_Texts":
        out = _Texts([], self.size)
        inside = keep[self.flat]
        out.n, out.flat, out.text = self.n, self.flat[inside], self.text[inside]
        return out

    def frequency(self) -> np.ndarray:
        return np.bincount(self.flat, minlength=self.size)

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.text, weights=weights[self.flat], minlength=self.n) + bias

    def spread(self, slope: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(self.flat, weights=slope[self.text], minlength=self.size), float(slope.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_non_negative(toxic: _Texts, unlabelled: _Texts, share: float, how: Training) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss."""
    weights, bias = np.zeros(toxic.size), 0.0
    moment, square = np.zeros(toxic.size + 1), np.zeros(toxic.size + 1)
    for step in range(1, how.steps + 1):
        on_toxic = toxic.scores(weights, bias)
        on_rest = unlabelled.scores(weights, bias)
        as_clean = np.logaddexp(0, on_rest).mean() - share * np.logaddexp(0, on_toxic).mean()
        # Slopes of the three mean losses; log(1 + e^-x) has -s(-x), log(1 + e^x) has s(x).
        up_toxic = -_sigmoid(-on_toxic) * share / max(1, toxic.n)
        down_toxic = -_sigmoid(on_toxic) * share / max(1, toxic.n)
        down_rest = _sigmoid(on_rest) / max(1, unlabelled.n)
        if as_clean >= -how.tolerance:
            (g1, b1), (g2, b2) = toxic.spread(up_toxic + down_toxic), unlabelled.spread(down_rest)
        else:
            (g1, b1), (g2, b2) = toxic.spread(-down_toxic), unlabelled.spread(-down_rest)
        slope = np.r_[g1 + g2 + how.decay * weights, b1 + b2]
        moment = 0.9 * moment + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        change = how.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - change[-1]
    return weights, bias


def _calibrate(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through labelled scores, by Newton steps."""
    if not len(scores) or toxic.min() == toxic.max():
        return 1.0, 0.0
    spread = scores.std() or 1.0
    x = np.stack([(scores - scores.mean()) / spread, np.ones(len(scores))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ at)
        slope = x.T @ (p - toxic) + 1e-3 * at
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, slope), -2, 2)
    a, b = max(at[0], 1e-6) / spread, at[1]
    return a, b - max(at[0], 1e-6) * scores.mean() / spread


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, how: Training = Training()) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) for which ``learn_from`` holds.

    Samples are the rows with the smallest hash of the id, so they do not depend on order
    or size. A document with several labels is toxic if one says so. None without toxic texts.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = store.materialise(known.filter(learn_from), "labels")
    count = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not count["toxic"]:
        return None
    share = min(max(count["toxic"] / count["n"], 1e-4), 1 - 1e-4)
    place = F.xxhash64("doc_id")
    rest = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & learn_from).withColumn("toxic", F.lit(None).cast("int"))
    # The parts overlap: a labelled text may be among the unlabelled ones, as in the corpus.
    chosen = (
        known.filter("toxic = 1").orderBy(place, "doc_id").limit(how.max_toxic).select("doc_id", F.lit("toxic").alias("part"), "toxic")
        .unionAll(rest.orderBy(place, "doc_id").limit(how.max_unlabelled).select("doc_id", F.lit("rest").alias("part"), "toxic"))
        .unionAll(known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(how.max_calibration).select("doc_id", F.lit("label").alias("part"), "toxic"))
    )
    # At most the three bounds' sum of rows, so this side may be broadcast.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(store.materialise(chosen.withColumn("toxic", F.col("toxic").cast("int")), "sample")), "doc_id")
        .mapInArrow(_sample_features(how.feature_bits), "part string, toxic int, features binary")
    )
    parts: dict[str, list] = {"toxic": [], "rest": [], "label": []}
    with store.lean_jobs(spark):
        for row in rows.toLocalIterator():
            parts[row["part"]].append((row["toxic"], bytes(row["features"])))
    size = 1 << how.feature_bits
    toxic, rest = (_Texts([f for _, f in parts[p]], size) for p in ("toxic", "rest"))
    if not toxic.n:
        return None
    often, usual = toxic.frequency(), rest.frequency()
    both = (often + usual) / (toxic.n + max(1, rest.n))
    contrast = often / toxic.n - usual / max(1, rest.n)
    error = np.sqrt(both * (1 - both) * (1 / toxic.n + 1 / max(1, rest.n))) + 1e-12
    keep = (often >= min(how.least_toxic_texts, toxic.n)) & (np.abs(contrast / error) >= how.least_contrast)
    weights, bias = fit_non_negative(toxic.only(keep), rest.only(keep), share, how)
    marks = np.array([t for t, _ in parts["label"]], dtype=float)
    slope, offset = _calibrate(_Texts([f for _, f in parts["label"]], size).scores(weights, bias), marks)
    return Model(weights * slope, bias * slope + offset, how.feature_bits)


def score(
    docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_column``, ``score`` and the columns ``keep`` for every row; without a model every score is 0.

    A null or empty text gets the score of a text without words. Columns not named are not
    read; those in ``keep`` must not be called ``key__``, ``score`` or like ``id_column``.
    """
    kept = [c for c in keep if c != text_column]
    rows = docs.select(F.col(id_column).cast("long").alias("key__"), text_column, *kept)
    if model is None:
        return rows.select(F.col("key__").alias(id_column), F.lit(0.0).alias("score"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType([rows.schema["key__"], StructField("score", DoubleType()), *[rows.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        wanted = m.weights != 0
        for batch in store.slices(batches, text_column, 1 << 20):
            doc, feature = _features(batch.column(text_column), m.bits, wanted)
            total = np.bincount(doc, weights=m.weights[feature], minlength=batch.num_rows) + m.bias
            columns = [batch.column("key__"), pa.array(_sigmoid(total)), *[batch.column(c) for c in keep]]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, out).withColumnRenamed("key__", id_column)
