"""Registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.session import use_utc
from folioscan.sources.tables import parquet_table
from folioscan.streaming.upsert import file_stream

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Reads the given tables by name, as a table or as a stream."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        return parquet_table(self.spark, self.folder, name)

    def stream(self, name: str) -> DataFrame:
        # Written as a pattern, so that a table of one file will do.
        path = f"{self.folder.rstrip('/')}/{name}.parque[t]"
        return file_stream(self.spark, path, self(name).schema, bytes_per_batch=STREAM_ROUND_BYTES)


# Input taken in one streaming round.
STREAM_ROUND_BYTES = 64 << 30

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            return build(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
