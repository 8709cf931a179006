"""Sources, paging and writing; documents and policies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.definition import ALL_FIELDS, NOT_ANALYZED_NO_NORMS, IndexDefinition, Indexing, Sort, Storage
from folioscan.functions.values import datetime_ticks
from folioscan.operators import fields
from folioscan.operators import predicates as q
from folioscan.operators.index_store import IndexFolder
from folioscan.plans import sql
from folioscan.plans.registry import query
from folioscan.session import scratch_path
from folioscan.sources import paging, visits
from folioscan.sources.tables import spread

# --- sources ---------------------------------------------------------------------------------


@query("source_scan", f"WITH {sql.ENCOUNTERS} SELECT * FROM src")
def source_scan(table):
    return visits.encounters(table("events"))


@query("source_filter", f"WITH {sql.ENCOUNTERS} SELECT uid_encounter, bit_Appointment FROM src WHERE NOT bit_Appointment")
def source_filter(table):
    return visits.not_appointments(visits.encounters(table("events"))).select("uid_encounter", "bit_Appointment")


@query(
    "source_projection",
    f"""WITH {sql.ENCOUNTERS}
    SELECT uid_encounter, EncounterID, ExternalId, uid_ProviderOrganization, uid_Patient, uid_ProviderLocation,
      dt_Visit, coalesce(OriginalAppointmentDateTime, dt_Visit) AS AppointmentDateTime, bit_Appointment, rowversion,
      dt_Seen IS NOT NULL AS seen, dt_CheckOut IS NOT NULL AS checkout, ViewedDateTime IS NOT NULL AS viewed,
      StartedDateTime IS NOT NULL AS started, AssignedProviderId, AssignedProviderServiceId,
      AssignedAppointmentLocationId
    FROM src""",
)
def source_projection(table):
    return visits.source_columns(visits.encounters(table("events")))


@query(
    "source_flags",
    f"""WITH {sql.ENCOUNTERS}
    SELECT uid_encounter, dt_Seen IS NOT NULL AS seen, dt_CheckOut IS NOT NULL AS checkout,
      ViewedDateTime IS NOT NULL AS viewed, StartedDateTime IS NOT NULL AS started FROM src""",
)
def source_flags(table):
    return visits.encounters(table("events")).select(
        "uid_encounter",
        visits.flag("dt_Seen").alias("seen"),
        visits.flag("dt_CheckOut").alias("checkout"),
        visits.flag("ViewedDateTime").alias("viewed"),
        visits.flag("StartedDateTime").alias("started"),
    )


@query(
    "keyset_page",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 4321 ORDER BY o_orderkey LIMIT 1000",
)
def keyset_page(table):
    orders = table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return paging.keyset_page(orders, "o_orderkey", after=4321)


@query(
    "keyset_batches",
    """SELECT o_orderkey, o_totalprice,
      CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS page FROM orders""",
)
def keyset_batches(table):
    return paging.keyset_batches(table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


_WIDE = ", ".join(
    f"{text} AS {name}" + (", VisitDateTime AS VisitDateTime_Range" if name == "VisitDateTime" else "")
    for name, text in sql.VISIT_TEXTS
    if name != "RowVersion"
)


def write_visit_index(table) -> IndexFolder:
    index = IndexFolder(table.spark, scratch_path(table.spark, "visits-index"), visits.VISITS)
    index.write(visits.visits(spread(table("events"))), "id", version=1)
    return index


@query("index_write", f"WITH {sql.VISITS} SELECT doc_id, RowVersion AS stored_RowVersion, {_WIDE} FROM visits")
def index_write(table):
    """Write the three index tables and read the documents back."""
    written = write_visit_index(table).documents()
    return written.drop("version", "RowVersion")


@query(
    "index_write_postings",
    f"""WITH {sql.VISIT_FIELDS}
    SELECT doc_id, field, 1 AS ord, 0 AS pos, 0 AS start_off, CAST(length(term) AS INTEGER) AS end_off, term
    FROM flds WHERE field <> 'RowVersion'""",
)
def index_write_postings(table):
    """The same write, reading the postings back."""
    return write_visit_index(table).postings().select("doc_id", "field", "ord", "pos", "start_off", "end_off", "term")


_USERS = IndexDefinition(name="users", indexing={"event_type": Indexing.NOT_ANALYZED}, storage={"event_id": Storage.YES})


@query(
    "index_search",
    """SELECT doc_id, event_id, value AS value_Range FROM (
      SELECT 'user-' || user_id AS doc_id, event_id, event_type, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1 AND event_type = 'purchase' AND value BETWEEN 5 AND 200""",
)
def index_search(table):
    """Two versions of an index of the users' last events, searched in its current state."""
    rows = table("events").select(F.concat(F.lit("User-"), "user_id").alias("id"), "event_id", "ts", "event_type", "value")
    index = IndexFolder(table.spark, scratch_path(table.spark, "users-index"), _USERS)
    early = col("ts") < F.lit("2024-01-16")
    index.write(rows.filter(early), "id", 1, seq=["ts", "event_id"])
    index.write(rows.filter(~early), "id", 2, seq=["ts", "event_id"])
    purchase = q.term(q.SearchField("event_type", "keyword"), "purchase")
    clause = q.must(purchase, q.range_clause(q.SearchField("value"), "Dx5", "Dx200", companion="value_Range"))
    return index.documents().filter(clause).select("doc_id", col("stored_event_id").alias("event_id"), "value_Range")


@query(
    "index_schema_change",
    """SELECT 'user-' || user_id AS doc_id, event_id, event_type, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value END AS value_Range FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def index_schema_change(table):
    """A second version with one column more and a wider key, compacted: no column is lost."""
    rows = table("events").select(F.concat(F.lit("User-"), "user_id").alias("id"), "event_id", "ts", "event_type", "value")
    index = IndexFolder(table.spark, scratch_path(table.spark, "users-index"), _USERS)
    early = col("ts") < F.lit("2024-01-16")
    narrow = rows.filter(early).drop("value").withColumn("event_id", col("event_id").cast("int"))
    index.write(narrow, "id", 1, seq=["ts", "event_id"])
    index.write(rows.filter(~early), "id", 2, seq=["ts", "event_id"])
    small = index.compact(scratch_path(table.spark, "users-compact"))
    return small.documents().select("doc_id", col("stored_event_id").alias("event_id"), "event_type", "value_Range")


@query(
    "stored_fields",
    f"""WITH {sql.VISITS}
    SELECT doc_id AS __document_id, RowVersion FROM visits
    WHERE ProviderOrganizationGuid = 'purchase' AND ProviderLocationGuid = '42'""",
)
def stored_fields(table):
    documents = fields.document_table(visits.visits(table("events")), "id", visits.VISITS)
    hits = documents.filter((col("ProviderOrganizationGuid") == "purchase") & (col("ProviderLocationGuid") == "42"))
    found = fields.stored_fields(hits, documents, ["RowVersion"])
    return found.select(col("doc_id").alias("__document_id"), "RowVersion")


# --- documents -------------------------------------------------------------------------------


@query("doc_id_normalize", "SELECT c_custkey, lower(c_name) AS doc_id FROM customer")
def doc_id_normalize(table):
    return table("customer").select("c_custkey", fields.document_id(col("c_name")).alias("doc_id"))


@query("visit_document", f"WITH {sql.VISITS} SELECT * FROM visits")
def visit_document(table):
    return visits.visits(table("events")).withColumnRenamed("id", "doc_id")


@query(
    "guid_lower",
    f"""WITH {sql.ENCOUNTERS} SELECT uid_encounter, lower(uid_ProviderOrganization) AS organization,
      lower(uid_Patient) AS patient, lower(uid_ProviderLocation) AS location FROM src""",
)
def guid_lower(table):
    return visits.encounters(table("events")).select(
        "uid_encounter",
        visits.lower_text("uid_ProviderOrganization").alias("organization"),
        visits.lower_text("uid_Patient").alias("patient"),
        visits.lower_text("uid_ProviderLocation").alias("location"),
    )


@query(
    "nullable_to_string",
    f"""WITH {sql.ENCOUNTERS} SELECT uid_encounter, ExternalId, AssignedProviderId, AssignedProviderServiceId,
      AssignedAppointmentLocationId, CAST(nullif(EncounterID, 8) AS VARCHAR) AS encounter_text FROM src""",
)
def nullable_to_string(table):
    source = visits.encounters(table("events")).withColumn("encounter_text", F.nullif("EncounterID", F.lit(8)))
    names = ["ExternalId", "AssignedProviderId", "AssignedProviderServiceId", "AssignedAppointmentLocationId"]
    return source.select("uid_encounter", *[visits.text_or_null(n).alias(n) for n in [*names, "encounter_text"]])


@query("datetime_ticks", "SELECT event_id, epoch_us(ts) * 10 + 621355968000000000 AS ticks FROM events")
def ticks(table):
    return table("events").select("event_id", datetime_ticks(col("ts")).alias("ticks"))


@query("fields_fanout", f"WITH {sql.VISIT_FIELDS} SELECT doc_id, field, term AS value FROM flds")
def fields_fanout(table):
    rows = fields.field_rows(visits.visits(spread(table("events"))), "id", visits.VISITS)
    return rows.select("doc_id", "field", col("term").alias("value"))


# --- policies --------------------------------------------------------------------------------

_MIXED = IndexDefinition(
    name="mixed",
    indexing={"RowVersion": Indexing.NO, "VisitDateTime": Indexing.DEFAULT, "Seen": Indexing.ANALYZED},
    storage={ALL_FIELDS: Storage.YES, "PatientGuid": Storage.NO},
    sorting={"VisitDateTime": Sort.LONG, "Seen": Sort.STRING},
    analyzers={"ExternalId": "custom"},
)
_ALL_RAW = IndexDefinition(name="raw", indexing={ALL_FIELDS: Indexing.NOT_ANALYZED, "Viewed": Indexing.DEFAULT})


def _names(table):
    return fields.field_rows(visits.visits(table("events")), "id", visits.VISITS).select("doc_id", "field")


@query(
    "resolve_indexing",
    f"""WITH {sql.VISIT_FIELDS}
    SELECT doc_id, field,
      CASE field WHEN 'RowVersion' THEN 'NO' WHEN 'Seen' THEN 'ANALYZED_NO_NORMS' WHEN 'ExternalId' THEN 'ANALYZED'
        ELSE 'NOT_ANALYZED_NO_NORMS' END AS index_mode,
      CASE field WHEN 'Viewed' THEN 'ANALYZED_NO_NORMS' ELSE 'NOT_ANALYZED_NO_NORMS' END AS all_fields_mode
    FROM flds""",
)
def resolve_indexing(table):
    own = fields.resolve_indexing(_names(table), _MIXED, NOT_ANALYZED_NO_NORMS).withColumnRenamed("index_mode", "_own")
    both = fields.resolve_indexing(own, _ALL_RAW)
    return both.select("doc_id", "field", col("_own").alias("index_mode"), col("index_mode").alias("all_fields_mode"))


@query("resolve_storage", f"WITH {sql.VISIT_FIELDS} SELECT doc_id, field, field <> 'PatientGuid' AS stored FROM flds")
def resolve_storage(table):
    return fields.resolve_storage(_names(table), _MIXED)


@query(
    "resolve_sort",
    f"""WITH {sql.VISIT_FIELDS}, both_names AS (
      SELECT doc_id, field FROM flds UNION ALL SELECT doc_id, field || '_Range' FROM flds)
    SELECT doc_id, field, CASE WHEN field IN ('VisitDateTime', 'VisitDateTime_Range') THEN 'Long'
      WHEN field IN ('Seen', 'Seen_Range') THEN 'String' ELSE 'None' END AS sort FROM both_names""",
)
def resolve_sort(table):
    names = _names(table)
    both = names.select("doc_id", F.explode(F.array("field", F.concat("field", F.lit("_Range")))).alias("field"))
    return fields.resolve_sort(both, _MIXED)


@query(
    "policy_filter_indexed",
    """SELECT doc_id, field, term, kind FROM (
      SELECT CAST(event_id AS VARCHAR) AS doc_id, 'props' AS field,
        CASE WHEN event_type = 'view' THEN 'NULL_VALUE' WHEN event_type = 'click' THEN 'EMPTY_STRING' END AS term,
        CASE WHEN event_type = 'view' THEN 'null' WHEN event_type = 'click' THEN 'empty' END AS kind FROM events
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'event_type', event_type, 'text' FROM events)
    WHERE term IS NOT NULL""",
)
def policy_filter_indexed(table):
    kind = col("event_type")
    props = F.when(kind == "view", None).when(kind == "click", "").otherwise(col("props"))
    source = table("events").select("event_id", props.alias("props"), "event_type")
    definition = IndexDefinition(name="events", indexing={"props": Indexing.NO, "event_type": Indexing.NOT_ANALYZED})
    rows = fields.searchable(fields.field_rows(source, "event_id", definition))
    return rows.select("doc_id", "field", "term", "kind")
