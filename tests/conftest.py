import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from check_oracles import session
    from signalgraph.sources.staging import clear

    spark = session()
    yield spark
    clear(spark)


@pytest.fixture(scope="session")
def make_logs(spark):
    """Log frames from short tuples: ts, service and any other column by name."""
    from signalgraph.schema import LOG_SCHEMA

    defaults = {
        "level": "INFO", "trace_id": "t", "parent_service": None, "latency_ms": 0.0,
        "status_code": 200, "message": "m", "template_id": None,
    }

    def make(rows):
        full = [{**defaults, "span_id": f"s{i:06d}", **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in LOG_SCHEMA.fieldNames()) for r in full], LOG_SCHEMA)

    return make
