import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import SCHEMA, odd_texts  # noqa: E402


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", "x", "y", 5, 0.5, "z") for i, t in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
