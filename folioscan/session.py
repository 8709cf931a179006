"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Short rows that a task is given at least before a table takes more tasks than there are cores.
TASK_ROWS = 250_000


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "folioscan") -> SparkSession:
    """A session for one machine: tests, the bench and trial runs. It sets its own shared folder."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="folioscan-"))
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamp text and ticks are defined on UTC wall-clock time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a folder below its warehouse; others must set it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; every call gets its own."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute when executors are lost, and values
    such as ``spark_partition_id`` stay fixed for every later pass.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many short rows, in no more tasks than these need, but as many as the session has cores.

    For a small outcome of a shuffle that would else be one task and one file for each of the shuffle's partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / TASK_ROWS)))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of a session for what runs inside, put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
