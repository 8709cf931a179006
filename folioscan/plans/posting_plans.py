"""Postings under each analyzer, and term statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.definition import IndexDefinition, Indexing
from folioscan.operators import fields
from folioscan.operators.index_store import IndexFolder
from folioscan.operators.postings import field_postings, text_postings, text_term_stats
from folioscan.plans import sql
from folioscan.plans.registry import query
from folioscan.session import scratch_path
from folioscan.sources.tables import spread

_LETTERS = r"\p{L}+"


def documents_with_text(table):
    return spread(table("documents").select("doc_id", "text"))


def document_postings(table, mode="standard", offsets=False):
    return text_postings(documents_with_text(table), col("doc_id"), "text", col("text"), mode, offsets=offsets)


_TEXTS = IndexDefinition(name="documents", indexing={"text": Indexing.ANALYZED})
_kept: dict[tuple, IndexFolder] = {}


def _stamps(table) -> tuple:
    """Path, size and time of the files of a folder's tables."""
    paths = table.spark._jvm.org.apache.hadoop.fs
    root = paths.Path(table.folder)
    files = root.getFileSystem(table.spark._jsc.hadoopConfiguration())
    found, waiting = [], [root]
    while waiting:
        for s in files.listStatus(waiting.pop()):
            if s.isDirectory():
                waiting.append(s.getPath())
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(found))


def kept_index(table, write) -> IndexFolder:
    """The index that ``write`` makes of a folder's tables: written by the first query of a session that searches it, kept for the others.

    It is written anew once any file of the folder is another than it was.
    """
    key = (table.spark.sparkContext.applicationId, table.folder, write.__name__, _stamps(table))
    if key not in _kept:
        _kept[key] = write(table)
    return _kept[key]


def write_text_index(table) -> IndexFolder:
    """An index of the documents' texts in two versions, the second with new texts for a tenth of the documents."""
    index = IndexFolder(table.spark, scratch_path(table.spark, "texts-index"), _TEXTS)
    docs = documents_with_text(table)
    again = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    stale = F.concat(F.lit("thanedble anea de la from "), col("text"))
    index.write(docs.withColumn("text", F.when(again, stale).otherwise(col("text"))), "doc_id", version=1)
    index.write(docs.filter(again), "doc_id", version=2)
    return index


def text_index(table) -> IndexFolder:
    return kept_index(table, write_text_index)


@query(
    "postings_lowercase_keyword",
    """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'p_name' AS field, 0 AS pos, 0 AS start_off,
      CAST(length(name) AS INTEGER) AS end_off, lower(name) AS term
    FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN '' ELSE upper(p_name) || ' Été' END AS name FROM part)
    WHERE name <> ''""",
)
def postings_lowercase_keyword(table):
    name = F.when(col("p_size") < 10, "").otherwise(F.concat(F.upper("p_name"), F.lit(" Été")))
    return text_postings(table("part"), col("p_partkey"), "p_name", name, "lowercase_keyword")


@query(
    "postings_offsets",
    rf"""WITH parts AS (
      SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS ws,
        string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS gs FROM documents),
    steps AS (
      SELECT doc_id, i, ws[i] AS word, length(gs[i]) + CASE WHEN i > 1 THEN length(ws[i - 1]) ELSE 0 END AS step
      FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM parts)),
    located AS (
      SELECT doc_id, i, word, sum(step) OVER (PARTITION BY doc_id ORDER BY i) AS start_off FROM steps)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'text' AS field, CAST(i - 1 AS INTEGER) AS pos,
      CAST(start_off AS INTEGER) AS start_off, CAST(start_off + length(word) AS INTEGER) AS end_off, lower(word) AS term
    FROM located WHERE lower(word) NOT IN {sql.STOPS}""",
)
def postings_offsets(table):
    return document_postings(table, offsets=True)


@query(
    "postings_keyword",
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'o_orderpriority' AS field, 0 AS pos, 0 AS start_off,
      CAST(length(o_orderpriority) AS INTEGER) AS end_off, o_orderpriority AS term FROM orders""",
)
def postings_keyword(table):
    return text_postings(table("orders"), col("o_orderkey"), "o_orderpriority", col("o_orderpriority"), "keyword")


@query(
    "postings_standard",
    f"""SELECT doc_id, 'text' AS field, pos, term
    FROM ({sql.words("documents", "doc_id", "text")}) WHERE term NOT IN {sql.STOPS}""",
)
def postings_standard(table):
    return document_postings(table)


@query(
    "postings_stop",
    f"""SELECT doc_id, 'text' AS field, pos, term
    FROM ({sql.words("documents", "doc_id", "text", _LETTERS)}) WHERE term NOT IN {sql.STOPS}""",
)
def postings_stop(table):
    return document_postings(table, "stop")


@query(
    "postings_simple",
    f"SELECT doc_id, 'text' AS field, pos, term FROM ({sql.words('documents', 'doc_id', 'text', _LETTERS)})",
)
def postings_simple(table):
    return document_postings(table, "simple")


_PER_FIELD = IndexDefinition(
    name="conversations",
    indexing={"text": Indexing.ANALYZED, "role": Indexing.NOT_ANALYZED, "title": Indexing.ANALYZED},
    analyzers={"title": "unregistered"},
)


@query(
    "postings_per_field",
    f"""WITH c AS (SELECT conv_id || '/' || turn AS key, text, upper(role) AS role, upper(role) || ' ' || turn AS title,
        upper(role) AS label FROM conversations)
    SELECT doc_id, 'text' AS field, pos, term FROM ({sql.words("c", "key", "text")}) WHERE term NOT IN {sql.STOPS}
    UNION ALL SELECT key, 'role', 0, role FROM c
    UNION ALL SELECT key, 'title', 0, lower(title) FROM c
    UNION ALL SELECT key, 'label', 0, lower(label) FROM c""",
)
def postings_per_field(table):
    """Words for ``text``, the raw value for ``role``, the lowered value for the rest."""
    role = F.upper("role")
    source = spread(table("conversations")).select(
        F.concat_ws("/", "conv_id", "turn").alias("key"),
        "text",
        role.alias("role"),
        F.concat_ws(" ", role, "turn").alias("title"),
        role.alias("label"),
    )
    rows = field_postings(fields.field_rows(source, "key", _PER_FIELD), _PER_FIELD)
    return rows.select("doc_id", "field", "pos", "term")


@query(
    "term_dictionary",
    f"""SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq
    FROM ({sql.words("documents", "doc_id", "text")}) WHERE term NOT IN {sql.STOPS} GROUP BY term""",
)
def term_dictionary(table):
    """The stored dictionary of a compacted index."""
    compacted = text_index(table).compact(scratch_path(table.spark, "texts-compacted"))
    return compacted.terms("text").drop("field")


@query(
    "term_dictionary_live",
    f"""SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq
    FROM ({sql.words("documents", "doc_id", "text")}) WHERE term NOT IN {sql.STOPS} GROUP BY term""",
)
def term_dictionary_live(table):
    """The stored dictionary of an index of two versions: what the second replaced is no longer counted."""
    return text_index(table).terms("text").drop("field")


@query(
    "term_stats",
    f"""SELECT 'text' AS field, term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq
    FROM ({sql.words("documents", "doc_id", "text")}) WHERE term NOT IN {sql.STOPS} GROUP BY term""",
)
def term_stats(table):
    return text_term_stats(documents_with_text(table), "text", col("text"))
