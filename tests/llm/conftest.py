import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    """Python workers load the package from the repository."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


@pytest.fixture
def frame(spark):
    """Rows dealt over a few partitions, so that no task sees them all."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
