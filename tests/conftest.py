import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from culprit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column function on one text."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
        return row.select(fn(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first()["x"]

    return run
