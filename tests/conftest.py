import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from pagemill.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "pagemill-tests")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet").cache()


@pytest.fixture
def rows(spark):
    """Rows from Python values: ``rows("id long, text string", (1, "a"))``."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)


@pytest.fixture
def value(spark):
    """Evaluate one expression over named strings: ``value(fn, text="a")``."""
    from pyspark.sql import functions as F

    def run(fn, **texts):
        df = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
        return df.select(fn(*[F.col(k) for k in texts]).alias("v")).first().v
    return run
