"""Language proportions of documents by expectation-maximisation.

Each language is a distribution of letter trigrams, counted over all training texts. A word
has a likelihood in each language; a document is a mixture of languages, its proportions
are found by expectation-maximisation over its words. Candidate sets of languages, the
strongest one, the strongest two and so on, are compared by their likelihood less a penalty
for each language in the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.llm import store
from plantweave.llm.words import Words, byte_table

#: Letters a-z and all bytes of non-ASCII characters; texts are in lower case.
_LETTERS = byte_table(bytes(b for b in range(256) if 0x61 <= b <= 0x7A or b >= 0x80))
_BITS = 16


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """Number of the trigram around each byte; all that are no letters look alike."""
    code = np.where(_LETTERS[raw], raw, np.uint8(32)).astype(np.uint32)
    left, right = np.empty_like(code), np.empty_like(code)
    left[:1], left[1:] = 32, code[:-1]
    right[-1:], right[:-1] = 32, code[1:]
    return (((left << np.uint32(16)) | (code << np.uint32(8)) | right) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


def _lower_words(column: pa.Array) -> Words:
    raw, bounds, _ = store.text_buffers(pc.utf8_lower(column))
    return Words(raw, bounds, _LETTERS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: how often each trigram occurs."""
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])
    totals: dict[str, np.ndarray] = {}
    for batch in store.slices(batches, "text", 1 << 20):
        words = _lower_words(batch.column("text"))
        grams = _trigrams(words.raw)
        inside = _LETTERS[words.raw]
        codes = pc.dictionary_encode(batch.column("lang"))
        of_doc = np.asarray(codes.indices)
        of_byte = np.repeat(of_doc, np.diff(words.bounds))[inside]
        grams = grams[inside]
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            add = np.bincount(grams[of_byte == k], minlength=1 << _BITS)
            totals[lang] = totals.get(lang, 0) + add
    rows = [{"lang": lang, "counts": c.astype(np.int64).tobytes()} for lang, c in totals.items()]
    if rows:
        yield store.rows_batch(rows, schema)


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in table.column("counts").to_pylist())
    return pa.Table.from_pylist([{"lang": table.column("lang")[0].as_py(), "counts": total.tobytes()}], schema=table.schema)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logs: np.ndarray  # float32, languages x trigrams


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", smoothing: float = 0.5) -> Model:
    """Trigram distributions of all languages that label a text; rows without text or label teach nothing.

    What reaches the driver is one table of ``2 ** 16`` counts per language.
    """
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    rows = rows.filter("lang is not null and text is not null").mapInArrow(_count, "lang string, counts binary")
    counts = rows.groupBy("lang").applyInArrow(_add, "lang string, counts binary")
    found = {r["lang"]: np.frombuffer(bytes(r["counts"]), dtype=np.int64) for r in counts.collect()}
    languages = sorted(found)
    table = np.zeros((len(languages), 1 << _BITS), dtype=np.float32)
    for i, lang in enumerate(languages):
        smoothed = found[lang] + smoothing
        table[i] = np.log(smoothed / smoothed.sum())
    return Model(languages, table)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each document's words; documents without words get 0."""
    total = np.zeros((values.shape[0], values.shape[1] + 1))
    np.cumsum(values, axis=1, out=total[:, 1:])
    return total[:, first[1:]] - total[:, first[:-1]]


def _mix(likely: np.ndarray, words: Words, docs: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood for these documents, from starting proportions (languages x documents)."""
    counts = words.counts[docs]
    first = np.r_[0, np.cumsum(counts)]
    at = np.repeat(words.first[docs] - first[:-1], counts) + np.arange(first[-1])
    own = np.repeat(np.arange(len(docs)), counts)
    likely = likely[:, at]
    fit = np.zeros(len(docs))
    for _ in range(rounds):
        joint = likely * share[:, own]
        total = joint.sum(axis=0)
        joint /= total
        share = _per_doc(joint, first) / np.maximum(counts, 1)
        fit = _per_doc(np.log(total)[None, :], first)[0]
    return share, fit


def proportions(model: Model, column: pa.Array, rounds: int, penalty: float, least_share: float) -> np.ndarray:
    """Languages x texts: the proportions in the best set of languages; all 0 for a text without letters."""
    words = _lower_words(column)
    n_lang, n_docs = len(model.languages), len(words.counts)
    out = np.zeros((n_lang, n_docs))
    if not len(words.starts) or not n_lang:
        return out
    grams = _trigrams(words.raw)
    logs = np.empty((n_lang, len(words.starts)))
    for k in range(n_lang):
        total = np.r_[0, np.cumsum(model.logs[k][grams], dtype=np.float64)]
        logs[k] = total[words.ends] - total[words.starts]
    top = logs.max(axis=0)
    # A small floor for every language, so that one odd word cannot rule a language out.
    likely = (np.exp(np.maximum(logs - top, -30.0)) + 1e-6).astype(np.float64)
    docs = np.flatnonzero(words.counts)
    alone = _per_doc(np.log(likely), words.first)[:, docs]
    share, _ = _mix(likely, words, docs, np.full((n_lang, len(docs)), 1 / n_lang), rounds)
    order = np.argsort(-share, axis=0, kind="stable")
    cost = penalty * np.log(words.counts[docs] + 1)
    best = alone.argmax(axis=0)
    result = np.zeros_like(share)
    result[best, np.arange(len(docs))] = 1.0
    value = alone.max(axis=0) - cost
    left = np.arange(len(docs))
    for size in range(2, n_lang + 1):
        # A set grows only by a language with some share in the full mixture.
        left = left[share[order[size - 1, left], left] >= least_share]
        if not len(left):
            break
        start = np.zeros((n_lang, len(left)))
        for rank in range(size):
            start[order[rank, left], np.arange(len(left))] = share[order[rank, left], left]
        found, fit = _mix(likely, words, docs[left], start / start.sum(axis=0), rounds)
        better = fit - size * cost[left] > value[left]
        result[:, left[better]] = found[:, better]
        value[left[better]] = (fit - size * cost[left])[better]
    out[:, docs] = result
    return out


def predict(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
    rounds: int = 6,
    penalty: float = 1.0,
    least_share: float = 0.02,
) -> DataFrame:
    """``id_column``, ``lang_pred``, ``score`` (its share of the text) and ``shares`` (language to share).

    A null text, one without letters, and any text if no language was learned is ``und``
    with score 0 and no shares. Equal shares go to the language first in order. Repeated
    rows each give a row; a null id stays null; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in store.slices(batches, "text", 1 << 20):
            column = batch.column("text")
            share = proportions(m, column, rounds, penalty, least_share)
            lettered = pc.match_substring_regex(column, r"\pL").fill_null(False)
            known = np.asarray(lettered) & (share.sum(axis=0) > 0)
            best = np.where(known, share.argmax(axis=0) if len(m.languages) else 0, len(m.languages))
            score = np.where(known, share.max(axis=0) if len(m.languages) else 0.0, 0.0)
            shares = [
                [(names[k], float(share[k, i])) for k in np.flatnonzero(share[:, i])] if ok else [] for i, ok in enumerate(known)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(np.clip(score, 0.0, 1.0)),
                    pa.array(shares, schema.field("shares").type),
                ],
                schema=schema,
            )

    texts = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    out = texts.mapInArrow(run, "key long, lang_pred string, score double, shares map<string,double>")
    return out.withColumnRenamed("key", id_column)
