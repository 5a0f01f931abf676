import pytest


@pytest.fixture
def frame(spark):
    """rows, schema -> DataFrame in two partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
