import pytest

from plantweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture
def metric_rows(spark):
    """Build metric rows from keyword dicts; missing columns take simple defaults."""
    from plantweave.schema import METRIC_COLUMNS, METRICS_DDL

    defaults = {
        "asset_id": "https://example.com/a1", "submodel": "S", "path": "S.p", "value": "1.0", "value_num": 1.0,
        "value_json": "1.0", "aas_type": "Property", "value_type": "xs:double", "semantic_keys": [],
        "aas_source": "f.json", "timestamp_ms": 0, "elem_order": "0",
    }

    def build(*rows):
        full = [{**defaults, **r} for r in rows]
        return spark.createDataFrame([tuple(r.get(c) for c in METRIC_COLUMNS) for r in full], METRICS_DDL)

    return build
