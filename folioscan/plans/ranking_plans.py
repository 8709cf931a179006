"""Relevance, typed sorts, top-k and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.definition import Sort
from folioscan.operators import predicates as q
from folioscan.operators import ranking
from folioscan.operators.bounded_topk import top_documents
from folioscan.operators.index_store import IndexFolder
from folioscan.plans import sql
from folioscan.plans.posting_plans import kept_index, text_index
from folioscan.plans.predicate_plans import VISIT_MATCH, VISIT_TERMS, visit_branches, visit_table
from folioscan.plans.registry import query
from folioscan.session import scratch_path
from folioscan.sources import visits
from folioscan.sources.tables import spread

PAGE = 50
TERMS = ["from", "les", "under"]


def _score(name="score"):
    return F.round(F.col(name), 6).alias(name)


# --- relevance -------------------------------------------------------------------------------


def write_changed_visit_index(table) -> IndexFolder:
    """An index of the visits in four versions: two write other kinds of a third of them, the last two write what they are."""
    index = IndexFolder(table.spark, scratch_path(table.spark, "changed-visits-index"), visits.VISITS)
    events = spread(table("events"))
    third, half = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0

    def kinds(kind, where):
        # Visits are not made of one kind of event; that one stays as it is.
        change = where & (col("event_type") != "signup")
        return events.withColumn("event_type", F.when(change, kind).otherwise(col("event_type")))

    index.write(visits.visits(kinds("purchase", third)), "id", version=1)
    index.write(visits.visits(kinds("error", third).filter(third & half)), "id", version=2)
    index.write(visits.visits(events.filter(third)), "id", version=3)
    index.write(visits.visits(events.filter(half)), "id", version=4)
    return index


def _scored_visits(table):
    """The sample query with scores over the stored index: exact terms by rarity, time ranges a constant 1."""
    index = kept_index(table, write_changed_visit_index)
    docs = index.documents()
    branches = visit_branches()
    terms = {f"idf_{b}_{i}": pair for b, pairs in enumerate(VISIT_TERMS) for i, pair in enumerate(pairs)}
    idfs = ranking.dictionary_idfs(index.terms(), index.document_count(), terms)
    clauses = []
    for b, (organization, location, span) in enumerate(branches):
        scored = [
            ranking.Scored(clause, ranking.term_score(F.lit(1), idfs[f"idf_{b}_{i}"]))
            for i, clause in enumerate((organization, location))
        ]
        clauses.append(ranking.all_of(*scored, ranking.constant(span)))
    whole = ranking.any_of(*clauses)
    return docs.filter(whole.matches).withColumn("score", whole.score)


def _visit_scores_sql(select, tail=""):
    return f"""WITH {sql.VISITS},
    n AS (SELECT count(*) AS n, count(*) FILTER (ProviderOrganizationGuid = 'purchase') AS o1,
      count(*) FILTER (ProviderLocationGuid = '42') AS l1, count(*) FILTER (ProviderOrganizationGuid = 'error') AS o2,
      count(*) FILTER (ProviderLocationGuid = '7') AS l2 FROM visits),
    idf AS (SELECT 1 + ln(n / (o1 + 1)) AS o1, 1 + ln(n / (l1 + 1)) AS l1, 1 + ln(n / (o2 + 1)) AS o2,
      1 + ln(n / (l2 + 1)) AS l2 FROM n),
    scored AS (
      SELECT doc_id, VisitDateTime AS VisitDateTime_Range, Seen,
        CASE WHEN ProviderOrganizationGuid = 'purchase' THEN (o1 * o1 + l1 * l1 + 1) * 0.5
          ELSE (o2 * o2 + l2 * l2 + 1) * 0.5 END AS score
      FROM visits, idf WHERE {VISIT_MATCH})
    {select} {tail}"""


@query(
    "topk_score",
    _visit_scores_sql("SELECT doc_id, round(score, 6) AS score FROM scored", f"ORDER BY round(score, 6) DESC, doc_id LIMIT {PAGE}"),
)
def topk_score(table):
    scored = _scored_visits(table).select("doc_id", _score())
    return ranking.top_by_score(scored, PAGE)


@query(
    "score_tfidf",
    f"""WITH t AS ({sql.words("documents", "doc_id", "text")}),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('from', 'les', 'under') GROUP BY ALL),
    idf AS (SELECT term, 1 + ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM tf GROUP BY term)
    SELECT doc_id, count(*) AS matched, round(sum(sqrt(tf) * idf * idf) * count(*) / 3, 6) AS score
    FROM tf JOIN idf USING (term) GROUP BY doc_id""",
)
def score_tfidf(table):
    index = text_index(table)
    scores = ranking.tfidf_scores(index.postings("text"), index.documents(), TERMS)
    return scores.select("doc_id", "matched", _score())


@query(
    "topk_bounded",
    f"""WITH t AS ({sql.words("documents", "doc_id", "text")}),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('from', 'les', 'under') GROUP BY ALL),
    idf AS (SELECT term, 1 + ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM tf GROUP BY term)
    SELECT doc_id, count(*) AS matched, round(sum(sqrt(tf) * idf * idf) * count(*) / 3, 6) AS score
    FROM tf JOIN idf USING (term) GROUP BY doc_id ORDER BY round(sum(sqrt(tf) * idf * idf) * count(*) / 3, 9) DESC, doc_id LIMIT {PAGE}""",
)
def topk_bounded(table):
    """The best documents for three terms over an index with replaced documents, by bounds of ranges."""
    return top_documents(text_index(table), "text", TERMS, PAGE).select("doc_id", "matched", _score())


@query(
    "score_constant",
    """SELECT p_partkey, ((CASE WHEN p_size BETWEEN 10 AND 20 THEN 1 ELSE 0 END) + (CASE WHEN p_name LIKE 'bl%' THEN 1 ELSE 0 END))
      * ((CASE WHEN p_size BETWEEN 10 AND 20 THEN 1 ELSE 0 END) + (CASE WHEN p_name LIKE 'bl%' THEN 1 ELSE 0 END))
      / CAST(2 AS DOUBLE) AS score
    FROM part WHERE p_size BETWEEN 10 AND 20 OR p_name LIKE 'bl%'""",
)
def score_constant(table):
    sizes = ranking.constant(q.range_clause(q.SearchField("p_size"), "Ix10", "Ix20"))
    names = ranking.constant(q.prefix(q.SearchField("p_name"), "bl"))
    either = ranking.any_of(sizes, names)
    return table("part").filter(either.matches).select("p_partkey", either.score.alias("score"))


@query("sort_with_scores", _visit_scores_sql(
    "SELECT doc_id, VisitDateTime_Range, round(score, 6) AS score, round(max(score) OVER (), 6) AS max_score FROM scored",
    f"ORDER BY VisitDateTime_Range, doc_id LIMIT {PAGE}",
))
def sort_with_scores(table):
    """Sorted by time, with scores and their maximum kept."""
    scored = ranking.with_max_score(_scored_visits(table))
    top = ranking.top_sorted(scored, _by_time(), PAGE)
    return top.select("doc_id", "VisitDateTime_Range", _score(), _score("max_score"))


@query("filter_arg", _visit_scores_sql("SELECT doc_id, round(score, 6) AS score FROM scored WHERE Seen"))
def filter_arg(table):
    """A filter beside the query takes rows away and adds no score."""
    seen = q.term(q.SearchField("Seen", "keyword"), "True")
    return _scored_visits(table).filter(seen).select("doc_id", _score())


# --- sorts -----------------------------------------------------------------------------------


def _by_time():
    return ranking.sort_order(col("VisitDateTime_Range"), Sort.LONG)


def _matching_visits(table):
    clause = q.should(*[q.must(*branch) for branch in visit_branches()])
    return visit_table(table).filter(clause).select("doc_id", "VisitDateTime_Range")


def _visits_sql(tail):
    return f"""WITH {sql.VISITS} SELECT doc_id, VisitDateTime AS VisitDateTime_Range FROM visits
    WHERE {VISIT_MATCH} ORDER BY VisitDateTime, doc_id {tail}"""


@query("topk_sorted", _visits_sql(f"LIMIT {PAGE}"))
def topk_sorted(table):
    return ranking.top_sorted(_matching_visits(table), _by_time(), PAGE)


@query(
    "page",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100",
)
def page(table):
    hits = table("orders").filter(q.term(q.SearchField("o_orderstatus", "keyword"), "F")).select("o_orderkey", "o_totalprice")
    return ranking.page(hits, ranking.sort_order(col("o_totalprice"), Sort.DOUBLE), start=100, size=PAGE, tie="o_orderkey")


@query("total_hits", "SELECT count(*) AS total_hits FROM orders WHERE o_orderstatus = 'F'")
def total_hits(table):
    return ranking.total_hits(table("orders").filter(q.term(q.SearchField("o_orderstatus", "keyword"), "F")))


_TYPED = [Sort.STRING, Sort.STRING_VAL, Sort.BYTE, Sort.SHORT, Sort.INT, Sort.LONG, Sort.FLOAT, Sort.DOUBLE]
_TEXT_SORTS = (Sort.STRING, Sort.STRING_VAL)


@query(
    "sort_typed",
    """WITH t AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS text, unnest(
        ['String', 'StringVal', 'Byte', 'Short', 'Int', 'Long', 'Float', 'Double']) AS sort FROM part)
    SELECT p_partkey, sort, text, row_number() OVER (PARTITION BY sort ORDER BY
      CASE WHEN sort NOT LIKE 'String%' THEN CAST(text AS INTEGER) END,
      CASE WHEN sort LIKE 'String%' THEN text END, p_partkey) AS place FROM t""",
)
def sort_typed(table):
    """The place of every part in each typed order of its size text."""
    text = col("p_size").cast("string")
    keys = [
        F.struct(
            F.lit(s.value).alias("sort"),
            (F.lit(0.0) if s in _TEXT_SORTS else ranking.sort_key(text, s).cast("double")).alias("number"),
            (ranking.sort_key(text, s) if s in _TEXT_SORTS else F.lit("")).alias("letters"),
        )
        for s in _TYPED
    ]
    rows = table("part").select("p_partkey", text.alias("text"), F.inline(F.array(*keys)))
    placed = ranking.number_rows(rows, ["number", "letters", "p_partkey"], "place", group=["sort"])
    return placed.select("p_partkey", "sort", "text", "place")


@query(
    "sort_custom",
    """SELECT p_partkey, row_number() OVER (ORDER BY length(p_name) DESC, reverse(p_name), p_partkey) AS place FROM part""",
)
def sort_custom(table):
    """A caller's own order: longest name first, then by its letters from the end."""
    keys = table("part").select("p_partkey", (-F.length("p_name")).alias("shortness"), F.reverse("p_name").alias("mirrored"))
    return ranking.number_rows(keys, ["shortness", "mirrored", "p_partkey"], "place").select("p_partkey", "place")


@query(
    "sort_missing",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size - 30 END AS size,
        CASE WHEN p_size > 10 THEN p_name END AS name FROM part)
    SELECT p_partkey, row_number() OVER (ORDER BY coalesce(size, 0), name NULLS FIRST, p_partkey) AS place FROM t""",
)
def sort_missing(table):
    """Without a number a document sorts as 0, without text before all text."""
    present = col("p_size") > 10
    size = ranking.sort_key(F.when(present, col("p_size") - 30), Sort.INT)
    name = ranking.sort_key(F.when(present, col("p_name")), Sort.STRING)
    keys = table("part").select("p_partkey", size.alias("size"), name.alias("name"))
    return ranking.number_rows(keys, ["size", "name", "p_partkey"], "place").select("p_partkey", "place")


@query(
    "q_mixed",
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders),
    i AS (SELECT 1 + ln(n / (f + 1)) AS f, 1 + ln(n / (u + 1)) AS u FROM n)
    SELECT CAST(o_orderkey AS VARCHAR) AS doc_id,
      round((f * f + CASE WHEN o_orderpriority = '1-URGENT' THEN u * u ELSE 0 END + CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END)
        * (1.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END + CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END) / 3, 6) AS score
    FROM orders, i WHERE o_orderstatus = 'F' AND NOT (o_totalprice > 200000)""",
)
def q_mixed(table):
    """One node with a required, two optional and an excluded clause."""
    status, urgent = col("o_orderstatus") == "F", col("o_orderpriority") == "1-URGENT"
    docs = ranking.with_term_idfs(table("orders"), {"_f": status, "_u": urgent})
    node = ranking.boolean(
        must=[ranking.Scored(status, ranking.term_score(F.lit(1), col("_f")))],
        should=[ranking.Scored(urgent, ranking.term_score(F.lit(1), col("_u"))), ranking.constant(col("o_totalprice") >= 100000)],
        must_not=[col("o_totalprice") > 200000],
    )
    return docs.filter(node.matches).select(col("o_orderkey").cast("string").alias("doc_id"), F.round(node.score, 6).alias("score"))
