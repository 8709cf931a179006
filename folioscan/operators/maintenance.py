"""Compaction, ingest counters, and checking and repairing an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioscan.operators.ranking import running_total
from folioscan.operators.upsert import latest


def compacted(df: DataFrame, cluster_by: list[str]) -> DataFrame:
    """The same rows in evenly sized partitions, clustered for pruning; write it to merge small files.

    The rebalance hint lets Spark size the output at run time and split a partition
    that one value makes too large.
    """
    return df.hint("rebalance", *[F.col(c) for c in cluster_by]).sortWithinPartitions(*cluster_by)


def ingest_counters(key: Column) -> list[Column]:
    """Counters of an ingest; a document without a usable id is an error."""
    usable = F.coalesce(F.trim(key.cast("string")) != "", F.lit(False))
    return [
        F.count("*").alias("attempts"),
        F.count_if(usable).alias("successes"),
        F.count_if(~usable).alias("errors"),
    ]


def ingest_stats(batch: DataFrame, key: str) -> DataFrame:
    """Counters of a batch, with the documents in and the distinct documents out."""
    ids = batch.groupBy(F.lower(F.col(key).cast("string")).alias("_id")).agg(F.count("*").alias("_n"))
    usable = F.coalesce(F.trim("_id") != "", F.lit(False))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    good = F.coalesce(F.sum(F.when(usable, F.col("_n"))), F.lit(0))
    return ids.agg(
        rows.alias("attempts"),
        good.alias("successes"),
        (rows - good).alias("errors"),
        rows.alias("docs_in"),
        F.count_if(usable).alias("docs_out"),
    )


def observed_ingest(batch: DataFrame, key: str, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """Count a batch while it is written: read ``observation.get`` after the write."""
    observation = Observation(name)
    return batch.observe(observation, *ingest_counters(F.col(key))), observation


def batch_report(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """Documents per batch and overall so far, from rows that carry a batch number."""
    counts = batches.groupBy(batch).agg(F.count("*").alias("batch_count"))
    return running_total(counts, [batch], F.col("batch_count"), "total_count")


def _bad_span() -> Column:
    return (F.col("pos") < 0) | (F.col("start_off") < 0) | (F.col("end_off") < F.col("start_off"))


def check_index(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """One row per check with the number of bad rows; all zero means clean.

    Both tables are counted per id before they meet, so each is read and shuffled once
    and an id with a great many rows is a single row in the join.
    """
    docs = documents.groupBy("doc_id").agg(F.count("*").alias("docs"))
    posts = postings.groupBy("doc_id").agg(
        F.count("*").alias("posts"), F.count_if(F.coalesce(_bad_span(), F.lit(False))).alias("bad")
    )
    has_id = F.col("doc_id").isNotNull()
    counts = docs.join(posts, "doc_id", "full_outer").agg(
        F.sum(F.when(~has_id, F.col("docs"))).alias("null_id"),
        F.sum(F.when(has_id, F.col("docs") - 1)).alias("duplicate_id"),
        F.sum(F.when(F.col("docs").isNull(), F.col("posts"))).alias("orphan_posting"),
        F.sum("bad").alias("bad_span"),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0)).alias("bad_rows")) for c in counts.columns])
    return counts.select(F.inline(rows))


def repair_documents(documents: DataFrame, seq: str | list[str]) -> DataFrame:
    """One row per id, the latest; rows without an id are dropped."""
    return latest(documents.filter(F.col("doc_id").isNotNull()), "doc_id", seq)


def repair_postings(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of known documents with sound positions.

    The unknown ids are found from the distinct ids; Spark chooses the join by their size
    and splits the postings of an oversized id (adaptive skew join).
    """
    ids = postings.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    unknown = ids.join(documents.select("doc_id"), "doc_id", "left_anti")
    sound = postings.filter(F.col("doc_id").isNotNull() & ~F.coalesce(_bad_span(), F.lit(False)))
    return sound.join(unknown, "doc_id", "left_anti")
