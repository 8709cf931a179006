"""Value-to-field rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.definition import IndexDefinition, Indexing, Sort, Storage
from folioscan.functions import values
from folioscan.operators import fields
from folioscan.plans.registry import query

_PLAIN = IndexDefinition(name="plain")


def _raw(*names):
    return IndexDefinition(name="raw", indexing={n: Indexing.NOT_ANALYZED for n in names})


def _rows(source, doc_id, definition=_PLAIN, columns=("doc_id", "field", "ord", "term", "kind")):
    return fields.field_rows(source, doc_id, definition).select(*columns)


@query(
    "field_name_check",
    r"""SELECT p_partkey, name, regexp_matches(name, '\S') AS is_valid FROM (
      SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN '' WHEN p_size < 10 THEN '  ' ELSE p_name END AS name FROM part)""",
)
def field_name_check(table):
    name = F.when(col("p_type") == "ECONOMY", "").when(col("p_size") < 10, "  ").otherwise(col("p_name"))
    return table("part").select("p_partkey", name.alias("name"), fields.is_valid_name(name).alias("is_valid"))


@query(
    "field_name_prefix",
    r"""SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[\p{L}_]') THEN o_orderpriority
      ELSE '_' || o_orderpriority END AS field, '_' || o_orderstatus AS marked FROM orders""",
)
def field_name_prefix(table):
    marked = fields.prefixed_name(F.concat(F.lit("_"), "o_orderstatus"))
    return table("orders").select(
        "o_orderkey", fields.prefixed_name(col("o_orderpriority")).alias("field"), marked.alias("marked")
    )


@query(
    "field_null",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'p_type' AS field, 1 AS ord,
      coalesce(nullif(p_type, 'ECONOMY'), 'NULL_VALUE') AS term,
      CASE WHEN p_type = 'ECONOMY' THEN 'null' ELSE 'text' END AS kind FROM part""",
)
def field_null(table):
    return _rows(table("part").select("p_partkey", F.nullif("p_type", F.lit("ECONOMY")).alias("p_type")), "p_partkey")


@query(
    "field_empty",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'p_type' AS field, 1 AS ord,
      CASE WHEN p_type = 'ECONOMY' THEN 'EMPTY_STRING' ELSE p_type END AS term,
      CASE WHEN p_type = 'ECONOMY' THEN 'empty' ELSE 'text' END AS kind FROM part""",
)
def field_empty(table):
    text = F.when(col("p_type") == "ECONOMY", "").otherwise(col("p_type"))
    return _rows(table("part").select("p_partkey", text.alias("p_type")), "p_partkey")


@query(
    "field_passthrough",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'p_name' AS field, p_name AS term, 'text' AS kind, FALSE AS stored FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Ready Made', upper(p_brand), 'ready', TRUE FROM part""",
)
def field_passthrough(table):
    part = table("part")
    made = fields.field_rows(part.select("p_partkey", "p_name"), "p_partkey", _PLAIN)
    ready = part.select(
        col("p_partkey").cast("string").alias("doc_id"),
        F.lit("Ready Made").alias("field"),
        F.lit(1).alias("ord"),
        F.lit(0).alias("first_pos"),
        F.upper("p_brand").alias("term"),
        F.lit("ready").alias("kind"),
        F.lit("keyword").alias("mode"),
        F.lit(None).cast("string").alias("range_type"),
        F.lit(None).cast("bigint").alias("num_long"),
        F.lit(None).cast("double").alias("num_double"),
        F.lit(True).alias("stored"),
        F.lit(True).alias("indexed"),
    )
    return fields.with_ready_rows(made, ready).select("doc_id", "field", "term", "kind", "stored")


# --- arrays ----------------------------------------------------------------------------------


@query(
    "field_array_explode",
    """SELECT CAST(vec_id AS VARCHAR) AS doc_id, 'embedding' AS field, CAST(i AS INTEGER) AS ord,
      CAST(embedding[i] AS DOUBLE) AS num_double
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'words', 1, NULL FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'words', 2, NULL FROM part""",
)
def field_array_explode(table):
    vectors = _rows(table("embeddings").select("vec_id", "embedding"), "vec_id", columns=_NUMBERED)
    words = table("part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return vectors.unionByName(_rows(words, "p_partkey", columns=_NUMBERED))


_NUMBERED = ("doc_id", "field", "ord", "num_double")


@query(
    "field_array_marker",
    """WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id,
        CASE WHEN p_size < 10 THEN [] ELSE string_split(p_name, ' ') END AS words FROM part)
    SELECT doc_id, 'words_IsArray' AS field, 'true' AS term, TRUE AS stored FROM w WHERE len(words) > 0
    UNION ALL SELECT doc_id, 'words', unnest(words), TRUE FROM w
    UNION ALL SELECT doc_id, 'unstored', unnest(words), FALSE FROM w""",
)
def field_array_marker(table):
    words = F.when(col("p_size") < 10, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    source = table("part").select("p_partkey", words.alias("words"), words.alias("unstored"))
    definition = IndexDefinition(name="part", storage={"words": Storage.YES})
    return _rows(source, "p_partkey", definition, ("doc_id", "field", "term", "stored"))


@query(
    "field_array_nested",
    """WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, [p_brand] || string_split(p_name, ' ') AS words FROM part)
    SELECT doc_id, 'nested_IsArray' AS field, 1 AS ord, 'true' AS term FROM w
    UNION ALL SELECT doc_id, 'nested', CAST(i AS INTEGER), words[i]
    FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)""",
)
def field_array_nested(table):
    nested = F.array(F.array("p_brand"), F.array().cast("array<string>"), F.split("p_name", " "))
    definition = IndexDefinition(name="part", storage={"nested": Storage.YES})
    source = table("part").select("p_partkey", nested.alias("nested"))
    return _rows(source, "p_partkey", definition, ("doc_id", "field", "ord", "term"))


@query(
    "field_array_nulls",
    """WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand, nullif(p_type, 'ECONOMY') AS p_type, p_name FROM part)
    SELECT doc_id, 'analysed' AS field, 1 AS ord, p_brand AS term FROM w
    UNION ALL SELECT doc_id, 'analysed', 2, p_type FROM w WHERE p_type IS NOT NULL
    UNION ALL SELECT doc_id, 'analysed', CASE WHEN p_type IS NULL THEN 2 ELSE 3 END, p_name FROM w
    UNION ALL SELECT doc_id, 'raw', 1, p_brand FROM w
    UNION ALL SELECT doc_id, 'raw', 2, coalesce(p_type, 'NULL_VALUE') FROM w
    UNION ALL SELECT doc_id, 'raw', 3, p_name FROM w""",
)
def field_array_nulls(table):
    items = F.array("p_brand", F.nullif("p_type", F.lit("ECONOMY")), "p_name")
    source = table("part").select("p_partkey", items.alias("analysed"), items.alias("raw"))
    return _rows(source, "p_partkey", _raw("raw"), ("doc_id", "field", "ord", "term"))


# --- scalar texts ----------------------------------------------------------------------------


@query(
    "field_not_analyzed",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, field, term, kind, num_long FROM (
      SELECT p_partkey, 'p_name' AS field, p_name AS term, 'text' AS kind, CAST(NULL AS BIGINT) AS num_long FROM part
      UNION ALL SELECT p_partkey, 'is_big', CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END, 'text', NULL FROM part
      UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), 'text', NULL FROM part
      UNION ALL SELECT p_partkey, 'price', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), 'text', NULL FROM part)""",
)
def field_not_analyzed(table):
    """Raw text, capitalised flags, decimal zeros kept, and no numeric companion."""
    source = table("part").select(
        "p_partkey",
        "p_name",
        (col("p_size") > 25).alias("is_big"),
        "p_size",
        col("p_retailprice").cast("decimal(12,2)").alias("price"),
    )
    definition = _raw("p_name", "is_big", "p_size", "price")
    return _rows(source, "p_partkey", definition, ("doc_id", "field", "term", "kind", "num_long"))


@query(
    "field_string",
    "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, lower(p_name) AS p_name, upper(p_name) AS stored_p_name FROM part",
)
def field_string(table):
    """Text under the default policy: analysed, which is to say lowered as a whole."""
    source = table("part").select("p_partkey", F.upper("p_name").alias("p_name"))
    return fields.document_table(source, "p_partkey", IndexDefinition(name="part", storage={"p_name": Storage.YES}))


@query(
    "field_datetime",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0' AS local_term,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS utc_term FROM events""",
)
def field_datetime(table):
    source = table("events").select("event_id", "ts", col("ts").cast("timestamp").alias("at"))
    wide = fields.document_table(source, "event_id", _PLAIN)
    return wide.select(
        col("doc_id").cast("bigint").alias("event_id"), col("ts").alias("local_term"), col("at").alias("utc_term")
    )


@query(
    "field_datetime_offset",
    """SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS utc_term,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+02:00' AS offset_term FROM events""",
)
def field_datetime_offset(table):
    offset = F.lit("+02:00")
    return table("events").select(
        "event_id",
        values.offset_datetime_text(col("ts"), offset, keep_offset=False).alias("utc_term"),
        values.offset_datetime_text(col("ts"), offset, keep_offset=True).alias("offset_term"),
    )


@query(
    "field_bool",
    "SELECT CAST(event_id AS VARCHAR) AS doc_id, CASE WHEN value > 100 THEN 'true' ELSE 'false' END AS term FROM events",
)
def field_bool(table):
    source = table("events").select("event_id", (col("value") > 100).alias("large"))
    return _rows(source, "event_id", columns=("doc_id", "term"))


@query(
    "field_decimal",
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
      rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '0'), '.') AS term,
      CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS num_double FROM orders""",
)
def field_decimal(table):
    source = table("orders").select("o_orderkey", col("o_totalprice").cast("decimal(14,2)").alias("price"))
    return _rows(source, "o_orderkey", columns=("doc_id", "term", "num_double"))


@query(
    "field_number_text",
    r"""SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS VARCHAR) AS line_text,
      CAST(l_orderkey AS VARCHAR) AS key_text, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\.0$', '') AS price_text,
      regexp_replace(CAST(l_quantity * 1000000 AS VARCHAR), '\.0$', '') AS large_text FROM lineitem""",
)
def field_number_text(table):
    source = table("lineitem").select(
        "l_orderkey",
        col("l_linenumber").alias("line_text"),
        col("l_orderkey").alias("key_text"),
        col("l_extendedprice").alias("price_text"),
        (col("l_quantity") * 1000000).alias("large_text"),
    )
    wide = fields.document_table(source, "l_orderkey", _PLAIN)
    return wide.select("doc_id", "line_text", "key_text", "price_text", "large_text")


@query(
    "field_json",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'object_ConvertToJson' AS field, 'true' AS term FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'object',
      '{"name":"' || p_name || '","size":' || p_size || '}' FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'entries_ConvertToJson', 'true' FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'entries', '{"' || p_brand || '":"' || p_type || '"}' FROM part""",
)
def field_json(table):
    source = table("part").select(
        "p_partkey",
        F.struct(col("p_name").alias("name"), col("p_size").alias("size")).alias("object"),
        F.create_map("p_brand", "p_type").alias("entries"),
    )
    return _rows(source, "p_partkey", columns=("doc_id", "field", "term"))


# --- numeric companions ----------------------------------------------------------------------


def _companions(source, doc_id, definition=_PLAIN):
    wide = fields.document_table(source, doc_id, definition)
    return wide.select("doc_id", *[c for c in wide.columns if c.endswith("_Range")])


@query(
    "field_range_int",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_size AS p_size_Range, CAST(p_size AS BIGINT) AS long_size_Range FROM part""",
)
def field_range_int(table):
    source = table("part").select("p_partkey", "p_size", col("p_size").alias("long_size"))
    return _companions(source, "p_partkey", IndexDefinition(name="part", sorting={"long_size": Sort.LONG}))


@query("field_range_long", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_custkey AS o_custkey_Range FROM orders")
def field_range_long(table):
    return _companions(table("orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(
    "field_range_decimal",
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
      CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS price_Range FROM orders""",
)
def field_range_decimal(table):
    source = table("orders").select("o_orderkey", col("o_totalprice").cast("decimal(14,2)").alias("price"))
    return _companions(source, "o_orderkey")


@query(
    "field_range_float",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(p_retailprice AS FLOAT) AS price_Range,
      CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS double_price_Range FROM part""",
)
def field_range_float(table):
    price = col("p_retailprice").cast("float")
    source = table("part").select("p_partkey", price.alias("price"), price.alias("double_price"))
    return _companions(source, "p_partkey", IndexDefinition(name="part", sorting={"double_price": Sort.DOUBLE}))


@query("field_range_double", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_totalprice AS o_totalprice_Range FROM orders")
def field_range_double(table):
    return _companions(table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
