"""The mix of sources against plain loops, and its schedule against the definition."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plantweave.llm import mixing, queries
from plantweave.llm.mixing import Mix, mix_sources

SCHEMA = "doc_id long, text string, source string, size string, key int, place double"


def corpus(spark):
    """A source with most words, small ones, one without words, a null one; nulls, repeated rows, a long text."""
    rows = [(i, "w " * (i % 37), "big", "s", 1, 2.0) for i in range(300)]
    rows += [(1000 + i, "a b c", "small", "s", 1, 2.0) for i in range(5)]
    rows += [(2000, None, "empty", "s", 1, 2.0), (2001, " \t\n", "empty", None, 1, 2.0), (None, "x y", None, "s", 1, 2.0)]
    rows += [(3000, "x " * 5000, "long", "s", 1, 2.0)] + [(7, "same text here", "twice", "s", 1, 2.0)] * 3
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("digits", [0, 1, 4, 7])
def test_points_below_equal_a_count(digits):
    slots = np.arange(1 << digits, dtype=np.int64)
    points = mixing.mirrored(slots, digits)
    for limit in (0, 1, (1 << digits) // 3, 1 << digits):
        want = [int((points[:i] < limit).sum()) for i in range(len(slots))]
        assert mixing.points_below(slots, np.int64(limit), digits).tolist() == want


def test_every_block_has_one_slot_and_sources_are_spread(spark):
    mix = Mix(corpus(spark), block=16)
    rows = mix.schedule().select("slot", "source_no", "block").distinct().collect()
    blocks = {r.source_no: r.blocks for r in mix.sources.collect()}
    assert len({r.slot for r in rows}) == len(rows) == sum(blocks.values())
    for source, n in blocks.items():
        own = sorted((r.slot, r.block) for r in rows if r.source_no == source)
        assert [b for _, b in own] == list(range(n))  # in the order of slots, a source gives block after block
    # In every beginning of the schedule the largest source has about its share of the slots there are.
    most = max(blocks, key=blocks.get)
    order = [r.source_no == most for r in sorted(rows)]
    share = blocks[most] / len(order)
    seen = np.cumsum(order) - share * np.arange(1, len(order) + 1)
    assert np.abs(seen).max() <= 2 + 2 * mix.digits


def test_targets_and_limits(spark):
    rows = mix_sources(corpus(spark), block=16).collect()
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] = r.source_size
        targets[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, full = set(names), set()
    while open_:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        over = {s for s in open_ if weights[s] * rest > 3 * sizes[s] * sum(weights[o] for o in open_)}
        if not over:
            break
        open_, full = open_ - over, full | over
    share = sum(weights[s] for s in open_)
    want = {s: 3 * sizes[s] if s in full else weights[s] * rest / share for s in names}
    assert targets == pytest.approx(want)
    assert all(abs(taken[s] - targets[s]) < 1 for s in names)
    assert len(rows) == corpus(spark).count()


def test_pieces_lie_end_to_end(spark):
    mix = Mix(corpus(spark), block=16)
    words = {r.source_no: r.words for r in mix.sources.collect()}
    held = {}
    for r in mix.schedule().collect():
        held.setdefault((r.source_no, r.block), 0)
        held[r.source_no, r.block] += r.length
    for (source, block), n in held.items():
        assert n == min(16, words[source] - 16 * block)


def test_reruns_agree_and_tables_without_words(spark):
    docs = corpus(spark)
    assert sorted(map(str, mix_sources(docs).collect())) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    assert mix_sources(docs.limit(0)).collect() == []
    assert {(r.target, r.taken) for r in mix_sources(docs.filter("source = 'empty'")).collect()} == {(0.0, 0)}


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    corpus(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES["op12_source_mixture"])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES["op12_source_mixture"](spark, str(tmp_path)).select(*[F.col(n) for n in names]).collect()
    # Rows that repeat an id and a size share what their places give; which of them stands first is open.
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))
