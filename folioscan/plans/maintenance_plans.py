"""Upserts, deletes, snapshots, compaction, counters, checks and dumps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.definition import IndexDefinition, Indexing
from folioscan.operators import fields, index_check, maintenance, upsert, zorder
from folioscan.operators.index_store import POSTING_ORDER, IndexFolder
from folioscan.plans import sql
from folioscan.plans.posting_plans import document_postings
from folioscan.plans.registry import query
from folioscan.session import scratch_path, written
from folioscan.sources import paging, visits

_CUT = "2024-01-16"
_USER_STATE = """SELECT doc_id, event_id, event_type, value FROM (
  SELECT 'user-' || user_id AS doc_id, event_id, event_type, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events {where}) WHERE rn = 1"""


def _user_events(table):
    return table("events").select(
        fields.document_id(F.concat(F.lit("User-"), "user_id")).alias("doc_id"), "event_id", "ts", "event_type", "value"
    )


@query("upsert_last_wins", _USER_STATE.format(where=""))
def upsert_last_wins(table):
    """The first half of the month as the table, the second half as the batch."""
    rows = _user_events(table)
    seq = ["ts", "event_id"]
    current = upsert.latest(rows.filter(col("ts") < F.lit(_CUT)), "doc_id", seq)
    batch = rows.filter(col("ts") >= F.lit(_CUT))
    return upsert.upsert(current, batch, "doc_id", seq).drop("ts")


@query(
    "delete_by_id",
    """SELECT doc_id, lang, source FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def delete_by_id(table):
    gone = table("labels").filter(col("toxic") == 1)
    return upsert.delete_by_id(table("documents").select("doc_id", "lang", "source"), gone, "doc_id")


def _versioned(table):
    return _user_events(table).withColumn("version", F.dayofmonth("ts"))


@query("snapshot_as_of", _USER_STATE.format(where="WHERE day(ts) <= 10"))
def snapshot_as_of(table):
    return upsert.snapshot_as_of(_versioned(table), "doc_id", 10, ["ts", "event_id"]).drop("version", "ts")


@query("compact_table", "SELECT * FROM orders")
def compact_table(table):
    """Write the table in many small files, then rewrite it compacted."""
    fragments = written(table("orders").repartition(32), "fragments")
    return written(maintenance.compacted(fragments, ["o_orderkey"]), "compacted")


@query("compact_zorder", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000 AND o_custkey < 100")
def compact_zorder(table):
    """The table compacted by two columns at once, read with a filter on both."""
    columns = ["o_totalprice", "o_custkey"]
    stored = written(zorder.zorder_compacted(table("orders").repartition(32), columns), "compacted")
    return stored.filter(col("o_totalprice").between(50000, 90000) & (col("o_custkey") < 100)).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "ingest_stats",
    """SELECT count(*) AS attempts, count(id) FILTER (trim(id) <> '') AS successes,
      count(*) - count(id) FILTER (trim(id) <> '') AS errors, count(*) AS docs_in,
      count(DISTINCT lower(id)) FILTER (trim(id) <> '') AS docs_out
    FROM (SELECT CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN ' '
      ELSE event_type || '-' || user_id END AS id FROM events)""",
)
def ingest_stats(table):
    kind = col("event_type")
    key = F.when(kind == "view", " ").when(kind != "error", F.concat_ws("-", kind, "user_id"))
    return maintenance.ingest_stats(table("events").select(key.alias("id")), "id")


@query(
    "ingest_batch_report",
    """SELECT batch, batch_count, CAST(sum(batch_count) OVER (ORDER BY batch) AS BIGINT) AS total_count FROM (
      SELECT CAST((rn - 1) // 1000 AS BIGINT) AS batch, count(*) AS batch_count
      FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1)""",
)
def ingest_batch_report(table):
    pages = paging.keyset_batches(table("events").select("event_id"), "event_id")
    return maintenance.batch_report(pages.withColumnRenamed("page", "batch"))


@query("changed_since_compact", "SELECT count(*) AS changed FROM events WHERE day(ts) > 20")
def changed_since_compact(table):
    return upsert.changed_since(_versioned(table), 20)


# Documents with repeated and missing ids, and postings some of which have no document or a bad span.
_DAMAGED_SQL = f"""
docs AS (
  SELECT CASE WHEN source <> 'src3' THEN CAST(doc_id AS VARCHAR) END AS doc_id, lang, n_chars AS seq FROM documents
  WHERE lang <> 'es'
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'again', n_chars + 1 FROM documents WHERE lang = 'de'),
posts AS (
  SELECT doc_id, pos, pos * 2 AS start_off, CASE WHEN term LIKE 'th%' THEN pos ELSE pos * 2 + 1 END AS end_off, term
  FROM ({sql.words("documents", "doc_id", "text")}) WHERE term NOT IN {sql.STOPS})"""


def _damaged(table):
    source = table("documents").select(col("doc_id").cast("string").alias("doc_id"), "lang", "source", "n_chars")
    first = source.filter(col("lang") != "es").select(
        F.when(col("source") != "src3", col("doc_id")).alias("doc_id"), "lang", col("n_chars").alias("seq")
    )
    again = source.filter(col("lang") == "de").select("doc_id", F.lit("again").alias("lang"), (col("n_chars") + 1).alias("seq"))
    start = col("pos") * 2
    postings = document_postings(table).select(
        "doc_id",
        "pos",
        start.alias("start_off"),
        F.when(col("term").startswith("th"), col("pos")).otherwise(start + 1).alias("end_off"),
        "term",
    )
    return first.unionByName(again), postings


@query(
    "check_index",
    f"""WITH {_DAMAGED_SQL}
    SELECT 'null_id' AS "check", count(*) AS bad_rows FROM docs WHERE doc_id IS NULL
    UNION ALL SELECT 'duplicate_id', CAST(count(doc_id) - count(DISTINCT doc_id) AS BIGINT) FROM docs
    UNION ALL SELECT 'orphan_posting', count(*) FROM posts WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE doc_id IS NOT NULL)
    UNION ALL SELECT 'bad_span', count(*) FROM posts WHERE end_off < start_off""",
)
def check_index(table):
    return maintenance.check_index(*_damaged(table))


@query(
    "repair_index",
    f"""WITH {_DAMAGED_SQL}
    SELECT 'document' AS part, doc_id, NULL AS pos, lang AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn FROM docs WHERE doc_id IS NOT NULL) WHERE rn = 1
    UNION ALL SELECT 'posting', doc_id, pos, term FROM posts
    WHERE end_off >= start_off AND doc_id IN (SELECT doc_id FROM docs WHERE doc_id IS NOT NULL)""",
)
def repair_index(table):
    documents, postings = _damaged(table)
    repaired = maintenance.repair_documents(documents, "seq")
    rows = maintenance.repair_postings(repaired, postings)
    part = repaired.select(F.lit("document").alias("part"), "doc_id", F.lit(None).cast("int").alias("pos"), col("lang").alias("value"))
    return part.unionByName(rows.select(F.lit("posting").alias("part"), "doc_id", "pos", col("term").alias("value")))


_DUMP_LINES = " || ".join(
    f"chr(9) || '{name} {'-S' if name == 'RowVersion' else 'I-'}: ' || {text} || chr(10)"
    + (" || chr(9) || 'VisitDateTime_Range I-: ' || VisitDateTime || chr(10)" if name == "VisitDateTime" else "")
    for name, text in sql.VISIT_TEXTS
)


@query(
    "document_dump",
    f"WITH {sql.VISITS} SELECT doc_id, chr(9) || '__document_id IS: ' || doc_id || chr(10) || {_DUMP_LINES} AS dump FROM visits",
)
def document_dump(table):
    return fields.document_dump(visits.visits(table("events")), "id", visits.VISITS)


# --- a kept index --------------------------------------------------------------------------

_PARTS = IndexDefinition(name="parts", indexing={"p_name": Indexing.ANALYZED})


def _part_index(table) -> IndexFolder:
    index = IndexFolder(table.spark, scratch_path(table.spark, "parts-index"), _PARTS)
    index.write(table("part").select("p_partkey", "p_name"), "p_partkey", version=1)
    return index


def _part_words(table, where=""):
    return f"SELECT doc_id, pos, term FROM ({sql.words(table, 'p_partkey', 'p_name')}) WHERE term NOT IN {sql.STOPS} {where}"


@query(
    "delete_from_index",
    f"""WITH live AS (SELECT p_partkey, p_name FROM part WHERE p_size <= 40
      UNION ALL SELECT p_partkey, 'again ' || p_name FROM part WHERE p_size > 45)
    {_part_words("live")}""",
)
def delete_from_index(table):
    """Large parts are deleted from a kept index, and the largest written again; a search sees what is live."""
    index, parts = _part_index(table), table("part")
    index.delete(parts.filter(col("p_size") > 40), "p_partkey", version=2)
    again = parts.filter(col("p_size") > 45).select("p_partkey", F.concat(F.lit("again "), "p_name").alias("p_name"))
    index.write(again, "p_partkey", version=3)
    return index.postings("p_name").select("doc_id", "pos", "term")


def _damaged_index(table) -> IndexFolder:
    """Two versions, the second with the names of small parts once more; then the first one's postings lose some terms."""
    index = _part_index(table)
    index.write(table("part").filter(col("p_size") < 10).select("p_partkey", "p_name"), "p_partkey", version=2)
    buckets, _ = index._layout()
    kept = index._bucketed_postings(1, buckets).filter(~col("term").startswith("b"))
    index._save(written(kept, "kept"), "postings", 1, buckets, "field", POSTING_ORDER)
    return index


@query(
    "check_kept_index",
    f"""SELECT 1 AS version, 'postings' AS name, 'p_name' AS field, 'rows' AS problem, count(*) AS expected,
      count(*) FILTER (term NOT LIKE 'b%') AS found FROM ({_part_words("part")})""",
)
def check_kept_index(table):
    """What a check of stored postings finds."""
    return index_check.check_kept_index(_damaged_index(table)).filter("name = 'postings'")


@query("repair_kept_index", _part_words("part"))
def repair_kept_index(table):
    """The live postings after repair."""
    index = _damaged_index(table)
    index_check.repair_kept_index(index)
    return index.postings("p_name").select("doc_id", "pos", "term")
