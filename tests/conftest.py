import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from contentgauge.session import local_session

    session = local_session(os.environ.get("CPUS", "8"), "tests")
    session.sparkContext.setLogLevel("FATAL")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """values(df_rows, schema, **columns) -> list of tuples, for column functions."""

    def run(rows, schema, *columns):
        return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]

    return run
