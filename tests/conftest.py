from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillspark.session import local_session  # noqa: E402
from tillspark.sources.schemas import SCHEMAS, align_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="tillspark-tests")
    yield s


@pytest.fixture(scope="session")
def frame(spark):
    """Build a table frame from dicts; missing columns take their defaults (align_schema)."""

    def make(table: str, rows: list[dict]):
        known = {f.name for f in SCHEMAS[table].fields}
        present = sorted({k for r in rows for k in r} & known)
        data = [tuple(None if r.get(c) is None else str(r.get(c)) for c in present) for r in rows]
        df = spark.createDataFrame(data, ",".join(f"`{c}` string" for c in present))
        return align_schema(df, table)

    return make
