import json

from plantweave.sources import documents
from plantweave.sources.rules import constraint_rules, mapping_rules
from plantweave.streaming import sinks
from plantweave.streaming.publish import PublishingSink
from tests.test_documents import environment, prop


def write(folder, name, *elements):
    (folder / name).write_text(json.dumps(environment(*elements, asset="urn:a")))


def test_documents_stream_through_the_pass(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    sink = PublishingSink(
        spark, str(tmp_path / "state"), mapping_rules(spark, {"default": {"enterprise": "E"}}),
        constraint_rules(spark, {"s": {"max": 10}}), reject_invalid=True,
    )

    def run():
        sinks.run_available_batches(documents.stream_documents(spark, str(folder)), sink, str(tmp_path / "cp"))
        return {r.topic: json.loads(r.payload)["value"] for r in sink.retained.read().collect()}

    sid = {"semanticId": {"keys": [{"value": "s"}]}}
    write(folder, "one.json", prop("a", "1", "xs:int", **sid), prop("b", "99", "xs:int", **sid), prop("c", "3", "xs:int", **sid))
    (folder / "broken.json").write_text("{")
    assert run() == {"E/urn:a/context/S/a": 1, "E/urn:a/context/S/c": 3}
    assert sink.births.read().count() == 1
    assert spark.read.parquet(f"{tmp_path}/state/bad_documents").count() == 1

    write(folder, "two.json", prop("a", "2", "xs:int", **sid), prop("c", "3", "xs:int", **sid), prop("d", "x", **sid))
    assert run() == {"E/urn:a/context/S/a": 2, "E/urn:a/context/S/c": 3, "E/urn:a/context/S/d": "x"}
    events = spark.read.parquet(f"{tmp_path}/state/drift_events")
    assert sorted((r.path, r.event_type) for r in events.filter("batch = 1").collect()) == [("S.b", "removed"), ("S.d", "added")]
    rows = spark.read.parquet(f"{tmp_path}/state/device_rows").filter("batch = 1").collect()
    assert sorted((r.path, r.kind) for r in rows) == [("S.a", "DDATA"), ("S.d", "DDATA")]
    assert sink.hashes.read().count() == 3
