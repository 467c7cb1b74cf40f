"""The metric table: the contract between all operators."""

from __future__ import annotations

METRICS_DDL = (
    "asset_id STRING, submodel STRING, path STRING, value STRING, value_num DOUBLE, "
    "value_bool BOOLEAN, value_json STRING, aas_type STRING, value_type STRING, "
    "semantic_id STRING, semantic_keys ARRAY<STRING>, unit STRING, aas_source STRING, "
    "timestamp_ms BIGINT, submodel_semantic_id STRING, elem_order STRING"
)

METRIC_COLUMNS = [part.split()[0] for part in METRICS_DDL.split(", ")]
