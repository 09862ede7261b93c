import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def frame(spark):
    """Documents (doc_id, text) with columns whose names an operator might use itself."""

    def make(rows):
        schema = "doc_id bigint, text string, score double, n bigint, ids string, run string"
        return spark.createDataFrame([(i, t, 0.5, 1, "x", "y") for i, t in rows], schema)

    return make
