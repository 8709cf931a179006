"""Reading source tables from files or from a SQL database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """Use all cores for a table that has fewer splits than there are cores.

    For a table as read from files, ahead of costly work per row. A large table has
    more splits than cores and is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def jdbc_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower_bound: int | str | None = None,
    upper_bound: int | str | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    **credentials: str,
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column the table is read in parallel slices."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **credentials}
    if partition_column is not None:
        if lower_bound is None or upper_bound is None:
            raise ValueError("a partitioned read needs both bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower_bound),
            "upperBound": str(upper_bound),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_table(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, **options) -> DataFrame:
    """A table of a SQL database; Spark pushes filters and the choice of columns to the database.

    A key that is no number or time, such as a GUID, is read in slices by a list of ``predicates``, one per task.
    """
    if predicates:
        given = jdbc_options(url, table, **options)
        return spark.read.jdbc(given.pop("url"), given.pop("dbtable"), predicates=predicates, properties=given)
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
