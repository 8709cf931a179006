import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.fixture
def table(spark):
    """A table over several partitions, empty ones among them."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(5)

    return make
