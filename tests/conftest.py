import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def tagged(spark):
    """Tag lists as a DataFrame with keys k0, k1, …"""

    def make(*lists):
        rows = [(f"k{i}", i, tags) for i, tags in enumerate(lists)]
        return spark.createDataFrame(rows, "image_key string, ord bigint, tags array<string>")

    return make


@pytest.fixture
def evaluate(tagged):
    """Evaluate a function of the tags column on lists and return the results in order."""

    def run(function, *lists):
        from pyspark.sql import functions as F

        df = tagged(*lists).select("ord", function(F.col("tags")).alias("out"))
        return [r.out for r in sorted(df.collect(), key=lambda r: r.ord)]

    return run
