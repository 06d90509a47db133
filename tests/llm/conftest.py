import pytest

from tests.llm import brute


@pytest.fixture(scope="session")
def rows():
    return brute.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)
