"""The given tables as streams, stored as files or as folders of files."""

import shutil

import pytest

import __spark_entry__ as entry
from boxweave.plans.views import TABLES


@pytest.mark.parametrize("name", ["report_stream", "report_stream_throttled", "telemetry_stream"])
def test_a_table_may_be_a_folder(spark, scratch, name):
    for t in TABLES:
        shutil.copyfile(f"{entry.SMOKE_DIR}/{t}.parquet", scratch / f"{t}.parquet")
    want = sorted(map(str, entry.queries()[name](spark, str(scratch)).collect()))
    for t in ("conversations", "events"):
        rows = spark.read.parquet(f"{entry.SMOKE_DIR}/{t}.parquet")
        (scratch / f"{t}.parquet").unlink()
        rows.repartition(3).write.parquet(str(scratch / f"{t}.parquet"))
    assert want and sorted(map(str, entry.queries()[name](spark, str(scratch)).collect())) == want
