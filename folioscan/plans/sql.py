"""SQL fragments shared by the oracles."""

from folioscan.definition import STOP_WORDS

STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"

ENCOUNTERS = """
src AS (
  SELECT event_id AS uid_encounter, user_id AS EncounterID,
    CASE WHEN event_type <> 'click' THEN 'EXT-' || user_id END AS ExternalId,
    upper(event_type) AS uid_ProviderOrganization, 'P-' || user_id AS uid_Patient,
    regexp_extract(props, '"k": *([0-9]+)', 1) AS uid_ProviderLocation, ts AS dt_Visit,
    CASE WHEN event_type <> 'view' THEN ts END AS OriginalAppointmentDateTime,
    event_type = 'signup' AS bit_Appointment, event_id AS rowversion,
    CASE WHEN event_type <> 'error' THEN ts END AS dt_Seen,
    CASE WHEN event_type <> 'click' THEN ts END AS dt_CheckOut,
    CASE WHEN event_type <> 'view' THEN ts END AS ViewedDateTime,
    CASE WHEN event_type <> 'purchase' THEN ts END AS StartedDateTime,
    nullif(event_type, 'view') AS AssignedProviderId,
    nullif(event_type, 'error') AS AssignedProviderServiceId,
    nullif(event_type, 'purchase') AS AssignedAppointmentLocationId
  FROM events)"""

VISITS = (
    ENCOUNTERS
    + """,
visits AS (
  SELECT CAST(uid_encounter AS VARCHAR) AS doc_id, CAST(rowversion AS VARCHAR) AS RowVersion,
    epoch_us(dt_Visit) * 10 + 621355968000000000 AS VisitDateTime, ExternalId,
    lower(uid_ProviderOrganization) AS ProviderOrganizationGuid, lower(uid_Patient) AS PatientGuid,
    lower(uid_ProviderLocation) AS ProviderLocationGuid, AssignedProviderId AS AssignedProviderGuid,
    AssignedProviderServiceId AS AssignedProviderServiceGuid,
    AssignedAppointmentLocationId AS AssignedAppointmentLocationGuid,
    dt_Seen IS NOT NULL AS Seen, dt_CheckOut IS NOT NULL AS CheckedOut,
    ViewedDateTime IS NOT NULL AS Viewed, StartedDateTime IS NOT NULL AS Started
  FROM src WHERE NOT bit_Appointment)"""
)

# Field texts of the visit documents, in field order: sentinels in place, flags as True/False.
VISIT_TEXTS = [
    ("RowVersion", "RowVersion"),
    ("VisitDateTime", "CAST(VisitDateTime AS VARCHAR)"),
    ("ExternalId", "coalesce(ExternalId, 'NULL_VALUE')"),
    ("ProviderOrganizationGuid", "ProviderOrganizationGuid"),
    ("PatientGuid", "PatientGuid"),
    ("ProviderLocationGuid", "ProviderLocationGuid"),
    ("AssignedProviderGuid", "coalesce(AssignedProviderGuid, 'NULL_VALUE')"),
    ("AssignedProviderServiceGuid", "coalesce(AssignedProviderServiceGuid, 'NULL_VALUE')"),
    ("AssignedAppointmentLocationGuid", "coalesce(AssignedAppointmentLocationGuid, 'NULL_VALUE')"),
    ("Seen", "CASE WHEN Seen THEN 'True' ELSE 'False' END"),
    ("CheckedOut", "CASE WHEN CheckedOut THEN 'True' ELSE 'False' END"),
    ("Viewed", "CASE WHEN Viewed THEN 'True' ELSE 'False' END"),
    ("Started", "CASE WHEN Started THEN 'True' ELSE 'False' END"),
]

VISIT_FIELDS = (
    VISITS
    + ",\nflds AS (\n"
    + "\nUNION ALL ".join(f"SELECT doc_id, '{name}' AS field, {text} AS term FROM visits" for name, text in VISIT_TEXTS)
    + ")"
)


def words(table: str, key: str, text: str, pattern: str = r"[\p{L}\p{N}]+") -> str:
    """A CTE body giving (doc_id, pos, term) of every word, stop words included."""
    return f"""
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lower(ws[i]) AS term
  FROM (SELECT CAST({key} AS VARCHAR) AS doc_id, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table}))"""
