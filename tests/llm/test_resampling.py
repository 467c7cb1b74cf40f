"""Feature hashing against zlib, and the draw against plain loops."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from plantweave.llm import resampling
from plantweave.llm.resampling import resample


def by_hand(docs, target, runs, buckets, share):
    def features(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        return len(words), [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]

    def count(texts):
        out = [0] * buckets
        for text in texts:
            for f in features(text)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count([x for _, x in docs]), count(target)
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: len(able) * share[0] // share[1]]
    rank = {id(r): i + 1 for i, r in enumerate(drawn)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


@pytest.mark.parametrize("runs", [1, 2])
def test_draw_equals_plain_loops(spark, odd_docs, docs, runs):
    both = odd_docs.select("doc_id", "text").unionAll(docs.selectExpr("doc_id + 100", "text"))
    texts = [(r.doc_id, r.text) for r in both.collect()]
    target = [None, "", "one two THREE four é", "word " * 50]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    got = resample(both, bench, runs=runs, buckets=500, share=(30, 100)).collect()
    want = by_hand(texts, target, runs, 500, (30, 100))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.rank is not None for r in got) > 10


def test_crcs_of_all_lengths_equal_zlib():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, 20_000, dtype=np.uint8)
    lengths = np.r_[0, 1, 1, 2, 3, resampling.WIDEST, resampling.WIDEST + 1, 9_000, rng.integers(0, 40, 300)].astype(np.int64)
    starts = rng.integers(0, 10_000, len(lengths))
    want = [zlib.crc32(raw[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert resampling.crc_by_length(raw, starts, lengths).tolist() == want


def test_features_in_bounded_pieces(spark, monkeypatch):
    """Pieces of a few bytes give what one piece gives, also within a long text and a long word."""
    rows = [(i, "ab cde " * (i % 50) + "x" * (700 if i == 3 else 1)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_hand(rows, ["ab x"], 1, 100, (10, 100))
    monkeypatch.setattr(resampling, "_CHUNK", 64)
    words = resampling.Words(np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.cumsum([0, *(len(t) for _, t in rows)]), resampling.ALNUM)
    small = sorted((int(d), int(b)) for doc, bucket in resampling.feature_buckets(words, 1, 100) for d, b in zip(doc, bucket))
    monkeypatch.undo()
    whole = sorted((int(d), int(b)) for doc, bucket in resampling.feature_buckets(words, 1, 100) for d, b in zip(doc, bucket))
    assert small == whole
    bench = spark.createDataFrame([("ab x",)], "text string")
    assert sorted(map(tuple, resample(docs, bench, buckets=100).collect()), key=str) == sorted(want, key=str)


def test_empty_tables_ties_and_clashing_names(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([], "text string")
    assert resample(no_docs, bench).collect() == []
    assert resample(odd_docs, bench, share=(0, 100)).filter("rank IS NOT NULL").count() == 0
    same = spark.createDataFrame([(5, "w " * 30, 1, 2)] * 10, "doc_id long, text string, rank int, score int")
    ranks = [r["rank"] for r in resample(same, bench, share=(50, 100)).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3, 4, 5] and len(ranks) == 10
