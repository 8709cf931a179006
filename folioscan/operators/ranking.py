"""Scores, sorts, top-k, pages, and numbering of large ordered tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.definition import Sort
from folioscan.session import written

# --- scored clauses --------------------------------------------------------------------------


@dataclass(frozen=True)
class Scored:
    """A clause with its relevance: ``score`` counts only where ``matches`` holds."""

    matches: Column
    score: Column

    @property
    def earned(self) -> Column:
        return F.when(self.matches, self.score).otherwise(F.lit(0.0))


def constant(matches: Column, score: float = 1.0) -> Scored:
    """Range and pattern clauses score a constant."""
    return Scored(matches, F.lit(float(score)))


def idf(doc_freq: Column, documents: Column) -> Column:
    return F.lit(1.0) + F.log(documents / (doc_freq + 1))


def term_score(tf: Column, idf_value: Column) -> Column:
    return F.sqrt(tf.cast("double")) * idf_value * idf_value


def _total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def all_of(*clauses: Scored) -> Scored:
    """Every clause must match; scores add up."""
    matches = reduce(lambda a, b: a & b, [c.matches for c in clauses])
    return Scored(matches, _total([c.earned for c in clauses]))


def any_of(*clauses: Scored) -> Scored:
    """At least one clause must match; the sum is scaled by the share of clauses that do."""
    matches = reduce(lambda a, b: a | b, [c.matches for c in clauses])
    matched = _total([F.when(c.matches, 1.0).otherwise(0.0) for c in clauses])
    return Scored(matches, _total([c.earned for c in clauses]) * matched / F.lit(float(len(clauses))))


def boolean(must: list[Scored] = (), should: list[Scored] = (), must_not: list[Column] = ()) -> Scored:
    """One node with required, optional and excluded clauses.

    Without required clauses one of the optional ones must match; with them these only add to the score. The
    sum of what matches is scaled by the share of all required and optional clauses that do. No clause at all
    matches nothing, excluded ones alone match what they do not exclude.
    """
    scored = [*must, *should]
    matches = F.lit(bool(scored or must_not))
    for clause in must:
        matches = matches & clause.matches
    if should and not must:
        matches = matches & reduce(lambda a, b: a | b, [c.matches for c in should])
    for clause in must_not:
        matches = matches & ~F.coalesce(clause, F.lit(False))
    if not scored:
        return Scored(matches, F.lit(0.0))
    matched = _total([F.when(c.matches, 1.0).otherwise(0.0) for c in scored])
    return Scored(matches, _total([c.earned for c in scored]) * matched / F.lit(float(len(scored))))


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct value for use in another table's columns."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def with_term_idfs(docs: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """Add an idf column per named term predicate; all document frequencies come from one aggregate."""
    counts = docs.agg(
        F.count("*").alias("_documents"),
        *[F.count_if(matches).alias("_df_" + name) for name, matches in terms.items()],
    )
    idfs = one_row(counts.select(*[idf(F.col("_df_" + n), F.col("_documents")).alias(n) for n in terms]))
    return docs.select("*", *[idfs[n].alias(n) for n in terms])


def dictionary_idfs(dictionary: DataFrame, documents: DataFrame | int, terms: dict[str, tuple[str, str]]) -> Column:
    """One struct with an idf per name, for named (field, term) pairs of a stored dictionary.

    Only these terms' entries are read, and the documents are only counted, if their number is not given. A term that the
    dictionary lacks is in no document.
    """
    pairs = {name: (F.col("field") == field) & (F.col("term") == term) for name, (field, term) in terms.items()}
    wanted = dictionary.filter(F.col("field").isin(*{f for f, _ in terms.values()}) & F.col("term").isin(*{t for _, t in terms.values()}))
    found = wanted.agg(*[F.coalesce(F.sum(F.when(pair, F.col("doc_freq"))), F.lit(0)).alias(name) for name, pair in pairs.items()])
    frequencies = one_row(found)
    total = F.lit(documents) if isinstance(documents, int) else documents.agg(F.count("*").alias("n")).scalar()
    return F.struct(*[idf(frequencies[name], total).alias(name) for name in terms])


def tfidf_scores(postings: DataFrame, documents: DataFrame, terms: list[str]) -> DataFrame:
    """Relevance of documents for a list of terms: (doc_id, matched, score).

    Sum of sqrt(tf) * idf^2 over the terms found, times the share of terms found, with
    idf = 1 + ln(N / (df + 1)) and no length norm. One shuffle groups the terms'
    postings by document into a frequency column per term; the document frequencies
    are a one-row aggregate of that same result, which Spark computes once.
    """
    wanted = list(dict.fromkeys(terms))
    names = [f"_tf{i}" for i in range(len(wanted))]
    per_document = (
        postings.filter(F.col("term").isin(*wanted))
        .groupBy("doc_id")
        .agg(*[F.count_if(F.col("term") == t).alias(n) for n, t in zip(names, wanted)])
    )
    frequencies = one_row(per_document.agg(*[F.count_if(F.col(n) > 0).alias(n) for n in names]))
    total = documents.agg(F.count("*").alias("n")).scalar()
    matched = _total([(F.col(n) > 0).cast("bigint") for n in names])
    scores = _total([term_score(F.col(n), idf(frequencies[n], total)) for n in names])
    share = matched / F.lit(float(len(wanted)))
    return per_document.select("doc_id", matched.alias("matched"), (scores * share).alias("score"))


# --- sorting and cutting ---------------------------------------------------------------------

_SORT_TYPES = {
    Sort.STRING: "string",
    Sort.STRING_VAL: "string",
    Sort.BYTE: "tinyint",
    Sort.SHORT: "smallint",
    Sort.INT: "int",
    Sort.LONG: "bigint",
    Sort.FLOAT: "float",
    Sort.DOUBLE: "double",
}


def sort_key(value: Column, sort: Sort) -> Column | None:
    """The typed key of a sort option; documents without a number sort as 0, without text first."""
    if sort is Sort.NONE:
        return None
    if sort is Sort.CUSTOM:
        return value
    spark_type = _SORT_TYPES[sort]
    key = value.try_cast(spark_type)
    return key if spark_type == "string" else F.coalesce(key, F.lit(0).cast(spark_type))


def least_value(values: Column) -> Column:
    """What a multi-valued field sorts by."""
    return F.array_min(values)


def sort_order(value: Column, sort: Sort, descending: bool = False) -> list[Column]:
    key = sort_key(value, sort)
    if key is None:
        return []
    return [key.desc_nulls_last() if descending else key.asc_nulls_first()]


def sort_custom(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order)


def top_by_score(scored: DataFrame, n: int, tie: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.col("score").desc(), F.col(tie)).limit(n)


def top_sorted(df: DataFrame, order: list[Column], n: int, tie: str = "doc_id") -> DataFrame:
    return df.orderBy(*order, F.col(tie)).limit(n)


def page(df: DataFrame, order: list[Column], start: int, size: int, tie: str = "doc_id") -> DataFrame:
    """Rows ``start`` to ``start + size`` of the order; for deep pages use ``sources.paging.keyset_page``."""
    return df.orderBy(*order, F.col(tie)).offset(start).limit(size)


def total_hits(df: DataFrame, name: str = "total_hits") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def with_max_score(scored: DataFrame) -> DataFrame:
    """Keep scores while sorting by a field: adds the greatest score to every row."""
    return scored.withColumn("max_score", scored.agg(F.max("score").alias("max_score")).scalar())


@dataclass(frozen=True)
class Found:
    """The answer to a search: the wanted rows, and the count of all matches beside them."""

    top: DataFrame
    total: DataFrame


def search(
    docs: DataFrame,
    query: Scored,
    size: int,
    start: int = 0,
    order: list[Column] | None = None,
    only: Column | None = None,
    tie: str = "doc_id",
) -> Found:
    """The best rows of a scored query, or the first by ``order``; ``only`` filters without scoring."""
    hits = docs.filter(query.matches if only is None else query.matches & only).withColumn("score", query.score)
    ranked = [F.col("score").desc()] if order is None else order
    return Found(page(hits, ranked, start, size, tie), total_hits(hits))


# --- numbering and running totals over any number of rows ------------------------------------


def _count(partitions: int | None) -> list[int]:
    return [] if partitions is None else [partitions]


def running_total(
    df: DataFrame, order: list[str], value: Column, name: str, group: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Running sum of ``value`` in the given order, within ``group`` if named, ending with the row itself.

    Rows are range-partitioned by group and order, so a large group spans many
    partitions and no task holds a whole group. The partitioned rows are written once;
    a sum per (partition, group) then gives each partition its starting total. The
    order must be unique for the result to be determined. ``partitions`` is the number of
    ranges, by default that of the session's shuffles; without a group one task sums a row for each of them.
    """
    group = group or []
    columns = df.columns
    ranged = df.withColumn("_value", value).repartitionByRange(*_count(partitions), *[F.col(c) for c in [*group, *order]])
    parts = written(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    sums = parts.groupBy("_part", *group).agg(F.sum("_value").alias("_sum"))
    # A row per partition and group: ranges keep groups together, so few rows per group.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(starts, ["_part", *group])
    return joined.select(*columns, (F.col("_start") + F.sum("_value").over(inside)).alias(name))


# Row ids made by Spark hold the partition above this many bits and the place in the partition below.
_PLACE_BITS = 33


def number_rows(
    df: DataFrame, order: list[str], name: str = "row_number", group: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Row numbers from 1 in a unique order, within ``group`` if named.

    Rows are range-partitioned and sorted once, and written with the id Spark gives
    them, which is their partition and their place in it. A count per (partition,
    group) then turns places into numbers: no window runs over the table and no task
    holds more than a range, however large a group is. ``partitions`` is the number of
    ranges, by default that of the session's shuffles; without a group one task adds up their counts.
    """
    group = group or []
    keys = [F.col(c) for c in [*group, *order]]
    ordered = df.repartitionByRange(*_count(partitions), *keys).sortWithinPartitions(*keys)
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _PLACE_BITS).alias("_part")
    counts = placed.groupBy(part, *group).agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # What to add to an id of this partition and group.
    shift = F.coalesce(F.sum("_count").over(earlier), F.lit(0)) + 1 - F.col("_first")
    shifts = counts.select("_part", *group, shift.alias("_shift"))
    joined = placed.withColumn("_part", part).join(shifts, ["_part", *group])
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
