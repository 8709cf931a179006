"""The sample source: encounter rows, selected and mapped to visit documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.definition import IndexDefinition, Indexing, Sort, Storage
from folioscan.functions.values import datetime_ticks

# The field policies of the sample index.
VISITS = IndexDefinition(
    name="Visits",
    indexing={
        "RowVersion": Indexing.NO,
        "VisitDateTime": Indexing.DEFAULT,
        "ExternalId": Indexing.NOT_ANALYZED,
        "ProviderOrganizationGuid": Indexing.NOT_ANALYZED,
        "PatientGuid": Indexing.NOT_ANALYZED,
        "ProviderLocationGuid": Indexing.NOT_ANALYZED,
        "AssignedProviderGuid": Indexing.NOT_ANALYZED,
        "AssignedProviderServiceGuid": Indexing.NOT_ANALYZED,
        "AssignedAppointmentLocationGuid": Indexing.NOT_ANALYZED,
        "Seen": Indexing.NOT_ANALYZED,
        "CheckedOut": Indexing.NOT_ANALYZED,
        "Viewed": Indexing.NOT_ANALYZED,
        "Started": Indexing.NOT_ANALYZED,
    },
    storage={"RowVersion": Storage.YES},
    sorting={"VisitDateTime": Sort.LONG},
)


def encounters(events: DataFrame) -> DataFrame:
    """The encounter table of the sample, derived from an ``events`` table."""
    kind = F.col("event_type")

    def unless(name: str) -> Column:
        return F.when(kind != name, F.col("ts"))

    return events.select(
        F.col("event_id").alias("uid_encounter"),
        F.col("user_id").alias("EncounterID"),
        F.when(kind != "click", F.concat(F.lit("EXT-"), F.col("user_id"))).alias("ExternalId"),
        F.upper(kind).alias("uid_ProviderOrganization"),
        F.concat(F.lit("P-"), F.col("user_id")).alias("uid_Patient"),
        F.get_json_object("props", "$.k").alias("uid_ProviderLocation"),
        F.col("ts").alias("dt_Visit"),
        unless("view").alias("OriginalAppointmentDateTime"),
        (kind == "signup").alias("bit_Appointment"),
        F.col("event_id").alias("rowversion"),
        unless("error").alias("dt_Seen"),
        unless("click").alias("dt_CheckOut"),
        unless("view").alias("ViewedDateTime"),
        unless("purchase").alias("StartedDateTime"),
        F.nullif(kind, F.lit("view")).alias("AssignedProviderId"),
        F.nullif(kind, F.lit("error")).alias("AssignedProviderServiceId"),
        F.nullif(kind, F.lit("purchase")).alias("AssignedAppointmentLocationId"),
    )


def not_appointments(source: DataFrame) -> DataFrame:
    return source.filter(~F.col("bit_Appointment"))


def flag(happened_at: str) -> Column:
    return F.col(happened_at).isNotNull()


def source_columns(source: DataFrame) -> DataFrame:
    """The 17 columns the sample reads."""
    return source.select(
        "uid_encounter",
        "EncounterID",
        "ExternalId",
        "uid_ProviderOrganization",
        "uid_Patient",
        "uid_ProviderLocation",
        "dt_Visit",
        F.coalesce("OriginalAppointmentDateTime", "dt_Visit").alias("AppointmentDateTime"),
        "bit_Appointment",
        F.col("rowversion").cast("bigint").alias("rowversion"),
        flag("dt_Seen").alias("seen"),
        flag("dt_CheckOut").alias("checkout"),
        flag("ViewedDateTime").alias("viewed"),
        flag("StartedDateTime").alias("started"),
        "AssignedProviderId",
        "AssignedProviderServiceId",
        "AssignedAppointmentLocationId",
    )


def lower_text(name: str) -> Column:
    return F.lower(F.col(name).cast("string"))


def text_or_null(name: str) -> Column:
    return F.col(name).cast("string")


def visit_documents(rows: DataFrame) -> DataFrame:
    """Source rows as visit documents: the id and 13 fields.

    ``ExternalId`` is the source's own external id.
    """
    return rows.select(
        F.col("uid_encounter").cast("string").alias("id"),
        text_or_null("rowversion").alias("RowVersion"),
        datetime_ticks(F.col("dt_Visit")).alias("VisitDateTime"),
        text_or_null("ExternalId").alias("ExternalId"),
        lower_text("uid_ProviderOrganization").alias("ProviderOrganizationGuid"),
        lower_text("uid_Patient").alias("PatientGuid"),
        lower_text("uid_ProviderLocation").alias("ProviderLocationGuid"),
        text_or_null("AssignedProviderId").alias("AssignedProviderGuid"),
        text_or_null("AssignedProviderServiceId").alias("AssignedProviderServiceGuid"),
        text_or_null("AssignedAppointmentLocationId").alias("AssignedAppointmentLocationGuid"),
        F.col("seen").alias("Seen"),
        F.col("checkout").alias("CheckedOut"),
        F.col("viewed").alias("Viewed"),
        F.col("started").alias("Started"),
    )


def visits(events: DataFrame) -> DataFrame:
    return visit_documents(source_columns(not_appointments(encounters(events))))
