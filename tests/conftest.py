import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packledger.session import local

DATA = os.environ.get("PACKLEDGER_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local(4, "tests", "6g")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def ev(spark):
    """Evaluate a Column function over a few texts."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[0] for r in df.coalesce(1).orderBy("i").select(fn(F.col("t"))).collect()]

    return run
