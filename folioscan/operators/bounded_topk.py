"""The best documents for some terms, without reading the ranges of documents that cannot hold any of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.index_store import IndexFolder
from folioscan.operators.ranking import idf, term_score
from folioscan.session import written

# Digits that decide between scores; documents with equal ones are ordered by id.
DIGITS = 9
# Ranges named in the filter of a scan; more of them are met by a join.
NAMED_RANGES = 1000


def _sum(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def term_idfs(index: IndexFolder, field: str, terms: list[str]) -> dict[str, float]:
    """Rarity of each term that live documents have, from the dictionary."""
    total = index.document_count()
    entries = index.terms(field).filter(F.col("term").isin(*terms))
    return {r.term: r.idf for r in entries.select("term", idf(F.col("doc_freq"), F.lit(total)).alias("idf")).collect()}


def scored_documents(postings: DataFrame, idfs: dict[str, float], terms: list[str]) -> DataFrame:
    """(doc_id, matched, score) of one-field postings, as ``ranking.tfidf_scores``, with rarities given."""
    names = {t: f"_tf{i}" for i, t in enumerate(terms) if t in idfs}
    found = postings.filter(F.col("term").isin(*names)).groupBy("doc_id").agg(*[F.count_if(F.col("term") == t).alias(n) for t, n in names.items()])
    matched = _sum([(F.col(n) > 0).cast("bigint") for n in names.values()])
    score = _sum([term_score(F.col(n), F.lit(idfs[t])) for t, n in names.items()]) * (matched / F.lit(float(len(terms))))
    return found.select("doc_id", matched.alias("matched"), score.alias("score"))


def _best(scored: DataFrame, size: int) -> DataFrame:
    return scored.orderBy(F.round("score", DIGITS).desc(), "doc_id").limit(size)


def range_bounds(index: IndexFolder, field: str, idfs: dict[str, float], terms: list[str]) -> DataFrame:
    """(rng, bound): no document of the range scores higher. Ranges without any of the terms do not appear."""
    names = {t: f"_most{i}" for i, t in enumerate(terms) if t in idfs}
    most = index.bounds(field).filter(F.col("term").isin(*names)).groupBy("rng").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("most"))), F.lit(0)).alias(n) for t, n in names.items()])
    present = _sum([(F.col(n) > 0).cast("bigint") for n in names.values()])
    bound = _sum([term_score(F.col(n), F.lit(idfs[t])) for t, n in names.items()]) * (present / F.lit(float(len(terms))))
    return most.select("rng", bound.alias("bound"))


def top_documents(index: IndexFolder, field: str, terms: list[str], size: int, first: int = 16) -> DataFrame:
    """(doc_id, matched, score) of the ``size`` best documents, the same as of a full sort; ties go to the lesser id.

    The greatest frequency of a term in a range of documents, kept at writing, bounds what any document of the range can
    score. The ``first`` ranges by bound are scored first; what their last document scores is the least that others must
    reach, and ranges bounded below it are not read. Frequencies and live documents are those of now, so
    deleted and replaced documents change neither order nor scores, they only leave a bound higher than need be.
    """
    if size < 1 or first < 1:
        raise ValueError("size and first must be 1 or more")
    terms = list(dict.fromkeys(terms))
    idfs = term_idfs(index, field, terms) if terms else {}
    postings = index.postings(field)
    if not idfs:
        return postings.select("doc_id", F.lit(0).cast("bigint").alias("matched"), F.lit(0.0).alias("score")).limit(0)
    ranges = written(range_bounds(index, field, idfs, terms), "ranges")
    leading = [r.rng for r in ranges.orderBy(F.col("bound").desc(), "rng").limit(first).collect()]
    best = written(_best(scored_documents(postings.filter(F.col("rng").isin(*leading)), idfs, terms), size), "best")
    found, least = best.agg(F.count("*"), F.min("score")).first()
    others = ranges.filter(~F.col("rng").isin(*leading))
    if found == size:
        others = others.filter(F.col("bound") >= F.lit(least - 10.0**-DIGITS))
    named = [r.rng for r in others.select("rng").limit(NAMED_RANGES + 1).collect()]
    if not named:
        return best.orderBy(F.round("score", DIGITS).desc(), "doc_id")
    if len(named) <= NAMED_RANGES:
        rest = postings.filter(F.col("rng").isin(*named))
    else:  # an index has buckets x ranges of them
        rest = postings.join(F.broadcast(others.select("rng")), "rng", "left_semi")
    return _best(best.unionByName(_best(scored_documents(rest, idfs, terms), size)), size)
