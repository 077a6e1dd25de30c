import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from bourselake.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate Column expressions over one row of literals: ``one(schema, row, expr, ...)``."""

    def run(schema, row, *exprs):
        r = spark.createDataFrame([row], schema).select(*exprs).first()
        return r[0] if len(exprs) == 1 else tuple(r)

    return run
