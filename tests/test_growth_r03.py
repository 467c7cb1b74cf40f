"""What a step costs per row: shuffles, states and passes over its input."""

import numpy as np
import pytest

from plantweave.operators import online
from tests.test_online import SHAPE, metrics  # noqa: F401


def test_short_assets_are_not_summed_over_blocks(metrics):  # noqa: F811
    plan = online.score_then_update(metrics, *SHAPE, block_rows=100_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


@pytest.mark.parametrize("n", [1, 20, 500])
def test_state_of_the_trees_follows_the_rows_of_its_key(n):
    rng, trees = np.random.default_rng(3), online.Replay(*SHAPE)
    f = rng.random((n + 30, 5))
    whole = trees.run(f)
    trees.start()
    first = trees.run(f[:n])
    codes, counts = trees.last_counts()
    assert len(codes) <= min(n * SHAPE[0], SHAPE[0] << SHAPE[1] - 1) and counts.sum() == n * SHAPE[0]
    again = online.Replay(*SHAPE)
    again.load(codes, counts)
    again.seen, again.low, again.high = trees.seen, trees.low, trees.high
    assert (again.mass == trees.mass).all()
    assert np.concatenate([first, again.run(f[n:])]).tolist() == whole.tolist()


def test_every_document_is_parsed_once(spark):
    from plantweave.plans import document_queries

    frame = document_queries.documents_parsed(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("Join") == 1


def test_walk_takes_no_variant_out_of_a_variant_twice_nor_its_text(spark):
    """Levels below the first few are found too; the text is not printed again to bound them."""
    import json

    from plantweave.operators import flatten
    from plantweave.sources import documents

    def deep(n):
        inner = [{"modelType": "Property", "idShort": "leaf", "value": n}]
        for i in range(n):
            inner = [{"modelType": "SubmodelElementCollection", "idShort": f"c{i}", "value": inner}]
        return json.dumps({"submodels": [{"idShort": "S", "id": "s", "submodelElements": inner}]})

    depths = [0, 1, flatten._SHALLOW - 1, flatten._SHALLOW, flatten._SHALLOW + 1, 60]
    texts = spark.createDataFrame([(str(n), n, deep(n)) for n in depths], "source string, event_ts long, content string")
    rows = flatten.flatten_documents(documents.with_doc(texts))
    assert {r.timestamp_ms: (r.path.count("."), r.value) for r in rows.collect()} == {n: (n + 1, str(n)) for n in depths}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrayType(VariantType" not in plan and plan.count("parseJson(") == 1


class _Entries:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        self.asked += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def getMapState(self, *_):
        return self


def test_changed_takes_many_keys_in_one_call():
    import pandas as pd

    from plantweave.streaming.processors import Changed

    entries, changed = _Entries(), Changed()
    changed.init(entries)

    def call(*rows):
        parts = iter([pd.DataFrame([r], columns=["k", "ts", "ord", "hash"]) for r in rows])
        return pd.concat(list(changed.handleInputRows((0,), parts, None)))["ord"].tolist()

    assert call(("b", 3, "3", "y"), ("a", 2, "2", "x"), ("a", 1, "1", "x"), ("b", 0, "0", "x"), ("c", 0, "7", None)) == ["1", "0", "3"]
    assert entries.asked == 0 and len(entries.rows) == 3
    assert call(("c", 9, "10", "z"), ("a", 8, "8", "x"), ("b", 9, "9", "x"), ("d", 1, "11", "x")) == ["9", "10", "11"]
    assert entries.asked == 4


def test_changed_values_are_hashed_behind_the_one_exchange(spark):
    from plantweave.streaming.processors import _in_buckets, changed_stream

    rows = spark.readStream.format("rate").load().selectExpr(
        "cast(value AS string) AS k", "value AS ts", "cast(value AS string) AS ord", "cast(value AS string) AS value_json"
    )
    plan = changed_stream(rows)._jdf.queryExecution().analyzed().toString()
    assert plan.index("sha2(") < plan.index("RepartitionByExpression") and plan.count("RepartitionByExpression") == 1
    keys = spark.range(5000).selectExpr("cast(id AS string) AS k")
    assert _in_buckets(keys, 16).select("bucket").distinct().count() == 16
