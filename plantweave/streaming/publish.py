"""The publishing pass over a stream of asset documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantweave.operators import flatten
from plantweave.operators.ordered import latest_per_key
from plantweave.plans.publish import State, publish_pass
from plantweave.session import ensure_checkpoint_dir
from plantweave.sources import documents
from plantweave.sources.rules import MappingRules
from plantweave.sources.sinks import KeyedTable, retained

FINGERPRINTS = (
    "asset_id STRING, submodel STRING, path STRING, aas_type STRING, value_type STRING, "
    "semantic_id STRING, unit STRING, fingerprint STRING"
)
HASHES = "topic STRING, hash STRING, updated_at BIGINT, created_at BIGINT"
RETAINED = "topic STRING, payload STRING, timestamp_ms BIGINT, elem_order STRING"


class PublishingSink:
    """``foreachBatch`` function: one pass per micro-batch on keyed state tables.

    Every table and event folder is written under the batch number, so a batch that is
    run again writes the same rows to the same places. Hashes are committed with the
    rows they belong to.
    """

    def __init__(
        self, spark: SparkSession, folder: str, rules: MappingRules, constraints: DataFrame, **options
    ):
        table = lambda name, schema: KeyedTable(spark, f"{folder}/{name}", schema)
        self.folder, self.rules, self.constraints, self.options = folder, rules, constraints, options
        self.fingerprints = table("fingerprints", FINGERPRINTS)
        self.hashes = table("hashes", HASHES)
        self.births = table("births", "device_id STRING")
        self.retained = table("retained", RETAINED)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(batch.sparkSession)
        parsed = documents.with_doc(batch)
        bad = parsed.filter("doc IS NULL").drop("doc")
        bad.write.mode("overwrite").parquet(f"{self.folder}/bad_documents/batch={batch_id}")
        metrics = flatten.flatten_documents(parsed).checkpoint()
        # Of several versions of a document in one batch the last one counts.
        last = latest_per_key(metrics, ["asset_id", "submodel", "path", "aas_source"], ["timestamp_ms", "elem_order"])
        state = State(
            fingerprints=self.fingerprints.read(before=batch_id),
            hashes=self.hashes.read(before=batch_id),
            births=self.births.read(before=batch_id),
        )
        result = publish_pass(
            last.select(*metrics.columns), state, self.rules, self.constraints, **self.options
        )
        result.drift_events.write.mode("overwrite").parquet(f"{self.folder}/drift_events/batch={batch_id}")
        result.device_rows.write.mode("overwrite").parquet(f"{self.folder}/device_rows/batch={batch_id}")
        before = self.retained.read(before=batch_id)
        now = before.unionByName(result.payloads)
        self.retained.write(retained(now, ["timestamp_ms", "elem_order"]), batch_id)
        born = state.births.unionByName(result.device_rows.select("device_id")).distinct()
        self.births.write(born, batch_id)
        self.fingerprints.write(result.next_fingerprints, batch_id)
        self.hashes.write(result.next_hashes, batch_id)

