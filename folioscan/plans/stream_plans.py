"""Structured Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.operators import fields
from folioscan.operators import predicates as q
from folioscan.operators.index_store import IndexFolder
from folioscan.plans import sql
from folioscan.plans.maintenance_plans import _USER_STATE
from folioscan.plans.predicate_plans import VISIT_MATCH, visit_branches
from folioscan.plans.registry import query
from folioscan.plans.source_plans import _USERS
from folioscan.session import scratch_path
from folioscan.sources import visits
from folioscan.streaming import upsert
from folioscan.streaming.poll import IndexPoll

_SEQ = ["ts", "event_id"]


def _user_rows(stream):
    return stream.select(
        fields.document_id(F.concat(F.lit("User-"), "user_id")).alias("doc_id"), "event_id", "ts", "event_type", "value"
    )


@query("stream_upsert", _USER_STATE.format(where=""))
def stream_upsert(table):
    sink, checkpoint = scratch_path(table.spark, "log"), scratch_path(table.spark, "progress")
    upsert.run_upserts(table.stream("events"), sink, checkpoint, _user_rows)
    return upsert.current_documents(table.spark, sink, "doc_id", _SEQ).drop("ts")


@query("stream_resume", "SELECT event_id, event_type, value FROM events")
def stream_resume(table):
    """Two runs on one checkpoint, with more input between them: every row arrives once."""
    events, spark = table("events"), table.spark
    folder, sink, checkpoint = (scratch_path(spark, x) for x in ("arrivals", "log", "progress"))
    early = col("ts") < F.lit("2024-01-16")
    for part in (events.filter(early), events.filter(~early)):
        part.write.mode("append").parquet(folder)
        stream = upsert.file_stream(spark, folder, events.schema, files_per_batch=1)
        upsert.run_upserts(stream.select("event_id", "event_type", "value"), sink, checkpoint)
    return spark.read.parquet(sink)


@query(
    "stream_index",
    """SELECT 'user-' || user_id AS doc_id, event_id, value AS value_Range FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1 AND event_type = 'purchase'""",
)
def stream_index(table):
    """Two rounds of a stream into an index folder, and a search of its current state."""
    spark, events = table.spark, table("events")
    folder, progress = scratch_path(spark, "arrivals"), scratch_path(spark, "progress")
    index = IndexFolder(spark, scratch_path(spark, "stream-index"), _USERS)
    early = col("ts") < F.lit("2024-01-16")
    for part in (events.filter(early), events.filter(~early)):
        part.write.mode("append").parquet(folder)
        stream = upsert.file_stream(spark, folder, events.schema)
        rows = stream.select(F.concat(F.lit("User-"), "user_id").alias("id"), "event_id", "ts", "event_type", "value")
        upsert.index_stream(rows, index, "id", ["ts", "event_id"], progress).awaitTermination()
    hits = index.documents().filter(q.term(q.SearchField("event_type", "keyword"), "purchase"))
    return hits.select("doc_id", col("stored_event_id").alias("event_id"), "value_Range")


@query(
    "stream_poll_query",
    f"""WITH {sql.VISITS} SELECT doc_id, VisitDateTime AS VisitDateTime_Range FROM visits
    WHERE {VISIT_MATCH} ORDER BY VisitDateTime, doc_id LIMIT 50""",
)
def stream_poll_query(table):
    """The sample query, asked after each round of a stream of visits into an index."""
    spark, events = table.spark, table("events")
    folder, progress = scratch_path(spark, "arrivals"), scratch_path(spark, "progress")
    index = IndexFolder(spark, scratch_path(spark, "visit-stream-index"), visits.VISITS)
    poll = IndexPoll(index, q.should(*[q.must(*branch) for branch in visit_branches()]), ["VisitDateTime_Range"], size=50)
    early = col("ts") < F.lit("2024-01-16")
    for part in (events.filter(early), events.filter(~early)):
        part.write.mode("append").parquet(folder)
        stream = upsert.file_stream(spark, folder, events.schema)
        upsert.index_stream(visits.visits(stream), index, "id", "RowVersion", progress).awaitTermination()
        found = poll.poll()
    return found
