"""Last-wins upserts, deletes and snapshots of document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(seq: str | list[str]) -> Column:
    """A struct, which is never null: a null in it sorts first."""
    return F.struct(*([seq] if isinstance(seq, str) else seq))


def latest(rows: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """The row with the greatest ``seq`` per key.

    Each task keeps one row per key before the shuffle, so a key with very many
    versions sends at most one row per task. A null ``seq`` counts as the least.
    """
    others = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*others), _order(seq)).alias("_row"))
    return kept.select(*[F.col(c) if c == key else F.col(f"_row.{c}") for c in rows.columns])


def upsert(current: DataFrame, batch: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """The table after a batch: later rows of the batch win, and the batch wins over the table.

    Table and batch are grouped by key together, once; ids must not be null.
    """
    order = [seq] if isinstance(seq, str) else list(seq)
    both = current.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    return latest(both, key, ["_batch", *order]).drop("_batch")


def delete_by_id(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def snapshot_as_of(log: DataFrame, key: str, version: int, seq: str | list[str], version_column: str = "version") -> DataFrame:
    """Documents as a reader sees them at a version: the latest row of each key up to it."""
    return latest(log.filter(F.col(version_column) <= F.lit(version)), key, seq)


def changed_since(log: DataFrame, version: int, version_column: str = "version") -> DataFrame:
    """How many documents were written after a version, repeats included."""
    return log.filter(F.col(version_column) > F.lit(version)).agg(F.count("*").alias("changed"))
