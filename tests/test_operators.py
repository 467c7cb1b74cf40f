import pytest
from pyspark.sql import functions as F

from plantweave.operators import alerts, commands, dedup, drift, fidelity, lifecycle, mapping, messages, semantic, validation
from plantweave.sources.rules import constraint_rules, mapping_rules
from plantweave.sources.sinks import KeyedTable, retained


def test_mapping_order_and_topic(spark, metric_rows):
    config = {
        "default": {"enterprise": "D"},
        "assets": {"urn:x/robot-1": {"enterprise": "E", "site": "S 1"}},
        "patterns": [{"pattern": "urn:*robot*", "enterprise": "P", "asset": "R"}, {"pattern": "*", "enterprise": "Q"}],
    }
    rules = mapping_rules(spark, config)
    rows = metric_rows(*[{"asset_id": a, "path": "S.L[0].v", "elem_order": str(i)} for i, a in enumerate(["urn:x/robot-1", "urn:x/robot-2", "urn:z#q", None])])
    got = {r.asset_id: r.topic for r in mapping.with_topics(rows, rules, root="uns").collect()}
    assert got == {
        "urn:x/robot-1": "uns/E/S_1/robot-1/context/S/L/a0a/v", "urn:x/robot-2": "uns/P/R/context/S/L/a0a/v",
        "urn:z#q": "uns/Q/q/context/S/L/a0a/v", None: "uns/D/context/S/L/a0a/v",
    }
    assert mapping_rules(spark, None).default == {"enterprise": "Default"}


def test_validation_errors(spark, metric_rows):
    constraints = constraint_rules(spark, {"t": {"min": 0, "max": 10, "unit": "C"}, "p": {"pattern": "[A-Z]+"}, "bad": {"pattern": "("}})
    text = {"value_num": None, "value": "abc", "value_json": '"abc"'}
    rows = metric_rows(
        {"path": "1", "semantic_id": "t", "unit": "C", "value_num": 10.0}, {"path": "2", "semantic_id": "t", "unit": "C", "value_num": 10.5},
        {"path": "3", "semantic_id": "t", "value_num": -1.0}, {"path": "4"}, {"path": "5", "semantic_id": "p", **text},
        {"path": "6", "semantic_id": "p", **text, "value": "ABc"}, {"path": "7", "semantic_id": "bad", **text}, {"path": "8", "aas_type": "Capability"},
    )
    got = {r.path: [e.error_type for e in r.errors] for r in validation.validate(rows, constraints).collect()}
    assert got == {
        "1": [], "2": ["value_out_of_range"], "3": ["value_out_of_range", "unit_mismatch"], "4": ["missing_semantic_id"],
        "5": ["pattern_mismatch"], "6": [], "7": [], "8": [],
    }
    assert validation.enforce(rows, constraints, level=1, reject_invalid=True).count() == 4
    assert validation.enforce(rows, constraints, level=0).count() == 8


def test_drift_chain_and_switches(spark, metric_rows):
    old = drift.fingerprints(metric_rows({"path": "a"}, {"path": "b", "unit": "m"}, {"path": "c", "semantic_id": "x"}, {"path": "gone"}))
    new = drift.fingerprints(metric_rows({"path": "a", "value_type": "xs:int", "unit": "k"}, {"path": "b"}, {"path": "c", "semantic_id": "y"}, {"path": "new"}))
    got = {r.path: r.event_type for r in drift.detect(old, new).collect()}
    assert got == {"a": "type_changed", "b": "unit_changed", "c": "semantic_changed", "gone": "removed", "new": "added"}
    assert {r.path for r in drift.detect(old, new, changes=False, removals=False).collect()} == {"new"}
    assert drift.replace_fingerprints(old, new).count() == 4


def test_ttl_and_cap(spark):
    rows = spark.createDataFrame([("t", ts, str(i), "1") for i, ts in enumerate([0, 5, 10, 12, 20, 29, 30])], "topic string, timestamp_ms bigint, elem_order string, value_json string")
    got = dedup.changed_in_series_with_ttl(rows, ttl_ms=10).collect()
    assert sorted(r.timestamp_ms for r in got) == [0, 10, 20, 30]
    table = spark.createDataFrame([(f"t{i}", "h", 0, i) for i in range(5)], "topic string, hash string, updated_at bigint, created_at bigint")
    assert {r.topic for r in dedup.cap_entries(table, 2).collect()} == {"t3", "t4"}
    assert {r.topic for r in dedup.not_expired(table, 10, 7).collect()} == {"t0", "t4"}


def test_hash_ignores_metadata_but_not_number_form(spark, metric_rows):
    rows = metric_rows({"value_json": "1"}, {"value_json": "1.0"}, {"value_json": "1", "timestamp_ms": 9, "unit": "m"})
    hashes = [r[0] for r in rows.select(dedup.value_hash(F.col("value_json"))).collect()]
    assert hashes[0] == hashes[2] != hashes[1]


def test_contexts_first_writer_wins(spark, metric_rows):
    rows = metric_rows({"semantic_id": "s", "unit": "b", "timestamp_ms": 2}, {"semantic_id": "s", "unit": "a", "timestamp_ms": 1}, {"semantic_id": ""}, {})
    first = semantic.register(semantic.contexts_of_metrics(rows))
    assert [(r.unit, r.hierarchy) for r in first.collect()] == [("a", ["s"])]
    assert semantic.register(semantic.contexts_of_metrics(rows), first).count() == 0


def test_fidelity_of_rich_and_poor(spark, metric_rows):
    rich = [{"asset_id": "rich", "path": f"S.g.p{i}", "semantic_id": "s", "semantic_keys": ["s", "t"], "unit": "m", "submodel_semantic_id": "x"} for i in range(4)]
    poor = [{"asset_id": "poor", "path": "unnamed"}, {"asset_id": "poor", "path": "b"}]
    got = {r.asset_id: r for r in fidelity.report(metric_rows(*rich, *poor)).collect()}
    assert got["rich"].overall_score == pytest.approx(1.0) and got["rich"].grade == "A+" and got["rich"].recommendations == []
    assert got["poor"].structural_fidelity == pytest.approx((0.36 + 0.45) / 2) and got["poor"].semantic_fidelity == 0
    assert got["poor"].recommendations[:3] == [
        "Metrics without a meaning: 2 (100% of the asset)", "Elements without a name: 1", "Numbers without a unit: 2",
    ]
    collapsed = {r.asset_id: r for r in fidelity.report(metric_rows(*rich), collapsed_keys=True).collect()}
    assert collapsed["rich"].entropy_loss == pytest.approx(1 - 2 / 3)


ACTIVITY = [("a", 0, "data"), ("a", 100, "data"), ("a", 500, "data"), ("a", 600, "death"), ("a", 650, "death"), ("a", 700, "data"),
            ("b", 10, "death"), ("b", 20, "data"), ("c", 0, "data"), ("c", 900, "death")]


def test_lifecycle_states(spark):
    rows = spark.createDataFrame([(a, t, k, i) for i, (a, t, k) in enumerate(ACTIVITY)], "asset_id string, ts bigint, kind string, seq bigint")
    got = sorted((r.asset_id, r.timestamp_ms, r.new_state, r.previous_state, r.reason) for r in lifecycle.events(rows, 1000, 300).collect())
    assert got == [
        ("a", 0, "online", None, "first_seen"), ("a", 400, "stale", "online", "no_data_for_0s"), ("a", 500, "online", "stale", "data_received"),
        ("a", 600, "offline", "online", "ddeath"), ("a", 700, "online", "offline", "data_received"),
        ("b", 20, "online", None, "first_seen"), ("b", 320, "stale", "online", "no_data_for_0s"),
        ("c", 0, "online", None, "first_seen"), ("c", 300, "stale", "online", "no_data_for_0s"), ("c", 900, "offline", "stale", "ddeath"),
    ]
    states = {r.asset_id: r.state for r in lifecycle.status(rows, 1000, 300).collect()}
    assert states == {"a": "online", "b": "stale", "c": "offline"}


def test_aliases_are_stable(spark):
    rows = spark.createDataFrame([("d", "p", 5), ("d", "q", 1), ("e", "p", 3), ("d", "p", 9)], "device_id string, path string, timestamp_ms bigint")
    first = messages.assign_aliases(rows)
    assert {r.metric_path: r.alias for r in first.collect()} == {"d/q": 1, "e/p": 2, "d/p": 3}
    more = rows.union(spark.createDataFrame([("z", "z", 0)], rows.schema))
    assert [(r.metric_path, r.alias) for r in messages.assign_aliases(more, first).collect()] == [("z/z", 4)]
    kept, gone = messages.evict_aliases(first, 3)
    assert gone.count() == 1 and kept.count() == 2 and messages.evict_aliases(first, 4)[1].count() == 0


def test_sequence_wraps_and_audit_is_clean(spark):
    log = [("n", None, "NBIRTH", 0, 0), ("n", "d", "DBIRTH", 1, 1)] + [("n", "d", "DDATA", i, i) for i in range(2, 300)] + [("n", None, "NBIRTH", 300, 300)]
    df = spark.createDataFrame(log, "node string, device_id string, kind string, ts bigint, seq_order bigint")
    got = {r.seq_order: (r.bd_seq, r.seq) for r in messages.sessions(df).collect()}
    assert got[0] == (0, 0) and got[255] == (0, 255) and got[256] == (0, 0) and got[300] == (1, 0)
    sent = messages.sessions(df).withColumn("qos", F.lit(0)).withColumn("retain", F.lit(False))
    assert {r.violations for r in messages.audit(sent, messages.early_messages(df)).collect()} == {0}
    late = df.filter("seq_order > 0")
    early = messages.early_messages(late)
    assert early.count() == 299
    sent = messages.sessions(late).withColumn("qos", F.lit(0)).withColumn("retain", F.lit(False))
    assert {(r.rule, r.violations) for r in messages.audit(sent, early).collect() if r.violations} == {("before_node_birth", 299)}


def test_bodies_split_without_loss(spark, metric_rows):
    rows = metric_rows(*[{"path": f"p{i}", "elem_order": str(i)} for i in range(25)]).withColumn("device_id", F.lit("d"))
    rows = rows.join(messages.assign_aliases(rows).select("path", "alias"), "path")
    parts = messages.bodies(rows, ["device_id"], messages.data_metric(), part_size=10).collect()
    assert sorted(p.metric_count for p in parts) == [5, 10, 10]


@pytest.mark.parametrize(
    "topic, payload, outcome",
    [
        ("A/cmd/S/Setpoints/x", '{"value": 1}', "success"), ("cmd/S/Setpoints/x", '{"value": null}', "success"),
        ("A/cmd/S/Identification/x", '{"value": 1}', "denied"), ("A/cmd/S/Other/x", '{"value": 1}', "denied"),
        ("A/cmd/S", '{"value": 1}', "invalid_path"), ("A/cmd/S/p/x", "{", "invalid_json"), ("A/cmd/S/p/x", "[1]", "missing_value"),
        ("A/cmd/S/p/x", '{"v": 1}', "missing_value"), ("A/cmd/S/p/ack", '{"value": 1}', None), ("A/data/S", "{}", None),
    ],
)
def test_commands(spark, topic, payload, outcome):
    df = spark.createDataFrame([(1, 5, topic, payload)], "event_id bigint, ts bigint, topic string, payload string")
    parsed, bad = commands.parse(df)
    done = commands.with_outcomes(commands.authorise(parsed), spark.createDataFrame([(1, None)], "event_id bigint, failure string"))
    got = [r.result for r in done.collect()] + [r.reason for r in bad.collect()]
    assert got == ([] if outcome is None else [outcome])
    if outcome in ("success", "denied"):
        assert commands.audit_trail(done).count() == 3


def test_counter_reset_and_hold(spark):
    rows = spark.createDataFrame([("c", "i", t, v) for t, v in [(0, 5.0), (10, 8.0), (20, 2.0), (30, 4.0)]], "name string, instance string, ts bigint, value double")
    got = {r.ts: r.increase for r in alerts.increase(rows, ["instance"], 20, 10).collect()}
    assert got == {10: 3.0, 20: 5.0, 30: 4.0}
    held = spark.createDataFrame([("i", t) for t in (0, 10, 20, 50, 60)], "instance string, ts bigint")
    assert {r.ts for r in alerts.held_for(held, ["instance"], 10, 10).collect()} == {10, 20, 60}


def test_retained_and_keyed_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "x", 1), ("b", None, 2)], "topic string, payload string, ts bigint")
    assert [(r.topic, r.payload) for r in retained(rows, ["ts"]).collect()] == [("a", "2")]
    table = KeyedTable(spark, str(tmp_path / "t"), "topic string, payload string, ts bigint")
    table.upsert(rows, ["topic"], ["ts"], 0)
    for _ in range(2):  # a repeated batch changes nothing
        table.upsert(rows.filter("topic = 'a'").withColumn("ts", F.col("ts") + 5), ["topic"], ["ts"], 1)
        assert {(r.topic, r.ts) for r in table.read().collect()} == {("a", 7), ("b", 2)}


def test_shared_topics_keep_one_hash(spark):
    from plantweave.operators import dedup

    table = spark.createDataFrame([], "topic string, hash string, updated_at long, created_at long")
    for now in range(1, 5):
        changed = spark.createDataFrame([("t", f"a{now}"), ("t", f"b{now}"), (f"u{now}", "c")], "topic string, hash string")
        table = dedup.merge_hashes(table, changed, F.lit(now).cast("bigint"))
        rows = {r.topic: (r.hash, r.updated_at, r.created_at) for r in table.collect()}
        assert table.count() == len(rows) == 1 + now and rows["t"] == (f"b{now}", now, 1)


def test_node_rebirth_stays_in_its_node(spark):
    requests = spark.createDataFrame([("n0", None, 5), ("n0", None, 3), ("n1", "d2", 4)], "node string, device_id string, ts long")
    state = spark.createDataFrame([("n0", "d0", "p"), ("n1", "d1", "p")], "node string, device_id string, path string")
    stored = spark.createDataFrame([("n0", "d3", "b"), ("n1", "d2", "b")], "node string, device_id string, payload string")
    got = sorted(tuple(r) for r in messages.rebirths(requests, state, stored).collect())
    assert got == [("n0", "d0", 5, "state", 1), ("n0", "d3", 5, "stored", 0), ("n1", "d2", 4, "stored", 0)]


def test_device_rebirth_stays_in_its_node(spark):
    requests = spark.createDataFrame([("n0", "dev", 5)], "node string, device_id string, ts long")
    state = spark.createDataFrame([("n0", "dev", "p"), ("n1", "dev", "p")], "node string, device_id string, path string")
    stored = spark.createDataFrame([], "node string, device_id string, payload string")
    assert [tuple(r) for r in messages.rebirths(requests, state, stored).collect()] == [("n0", "dev", 5, "state", 1)]


def test_hash_of_the_later_element_is_stored(spark):
    table = spark.createDataFrame([], "topic string, hash string, updated_at long, created_at long")
    changed = spark.createDataFrame([("t", "z", "1"), ("t", "a", "2")], "topic string, hash string, elem_order string")
    got = dedup.merge_hashes(table, changed, F.lit(3).cast("bigint"), ("elem_order",)).collect()
    assert [(r.topic, r.hash) for r in got] == [("t", "a")]


def test_a_repeated_pass_publishes_nothing(spark, metric_rows):
    """Rows that share a topic at one instant give one payload, whose hash is stored."""
    from plantweave.plans.publish import State, publish_pass
    from plantweave.streaming.publish import FINGERPRINTS, HASHES

    rows = metric_rows(
        {"value_json": "9", "elem_order": "1"}, {"asset_id": "https://other.com/a1", "value_json": "1", "elem_order": "2"},
        {"asset_id": "https://third.com/a1", "value_json": "5", "elem_order": "2"}, {"path": "S.q", "value_json": "7"},
    )
    hashes = spark.createDataFrame([], HASHES)
    rules, constraints = mapping_rules(spark, {"default": {"enterprise": "E"}}), constraint_rules(spark, {})
    counts = []
    for _ in range(3):
        state = State(spark.createDataFrame([], FINGERPRINTS), hashes, spark.createDataFrame([], "device_id string"))
        result = publish_pass(rows, state, rules, constraints, reject_invalid=False)
        counts.append(result.payloads.count())
        hashes = spark.createDataFrame(result.next_hashes.collect(), HASHES)
    assert counts == [2, 0, 0]
