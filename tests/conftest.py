import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of one expression over rows of given texts."""

    def run(build, values, schema="v string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {schema}")
        return [r["out"] for r in df.select("i", build.alias("out")).orderBy("i").collect()]

    return run
