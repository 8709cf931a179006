"""Whether what lies in an index folder is what was written, and mending what can be made anew from the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.index_store import SUMMED, IndexFolder, union_all
from folioscan.operators.postings import field_postings
from folioscan.session import written

# Tables that are made from the fields of a version.
DERIVED = {"postings", "terms", "bounds"}


def check_kept_index(index: IndexFolder) -> DataFrame:
    """(version, name, field, problem, expected, found): one row for each stored table and field that is not sound; none if all is.

    Rows and content of each table, version and field are compared with the sums kept at writing (``rows`` and ``content``;
    ``no sums`` where none were kept). The dictionary is counted anew from the postings (``terms``: entries that should be there,
    and those that are right), and ``left`` names ids that the version they are said to have stood in does not hold.
    """
    spark, versions = index.spark, index.versions()
    summed = [v for v in versions if v in index._of_table("sums")]
    schema = "version int, name string, field string, problem string, expected bigint, found bigint"
    if not versions:
        return spark.createDataFrame([], schema)
    parts = [spark.createDataFrame([(v, "sums", "", "no sums", 1, 0) for v in versions if v not in summed], schema)]
    if summed:
        kept = spark.read.parquet(index._table("sums")).filter(F.col("version").isin(*summed))
        now = union_all([index.content_sums(name, there) for name in SUMMED if (there := [v for v in summed if v in index._of_table(name)])])
        both = kept.select("version", "name", "field", F.col("rows").alias("expected"), F.col("content").alias("sum")).join(now, ["version", "name", "field"], "full")
        counts = [F.coalesce(c, F.lit(0)).alias(n) for c, n in (("expected", "expected"), ("rows", "found"))]
        problem = F.when(F.col("expected").eqNullSafe(F.col("rows")), "content").otherwise("rows").alias("problem")
        changed = ~(F.col("expected").eqNullSafe(F.col("rows")) & F.col("sum").eqNullSafe(F.col("content")))
        parts.append(both.filter(changed).select("version", "name", "field", problem, *counts))
    layout = index._layout()
    if layout is not None:
        parts += _dictionary_faults(index, versions, layout[0])
    return union_all(parts)


def _dictionary_faults(index: IndexFolder, versions: list[int], buckets: int) -> list[DataFrame]:
    out, there = [], set(index._of_table("terms"))
    for v in versions:
        if v in there:
            right = index.term_changes(v, buckets)
            stored = index.spark.read.schema(index._stored_schema("terms")).parquet(index._table("terms")).filter(F.col("version") == v)
            columns = ["field", "term", "doc_freq", "total_freq"]
            marked = right.select(*columns, F.lit(1).alias("should"), F.lit(0).alias("is")).unionByName(stored.select(*columns, F.lit(0).alias("should"), F.lit(1).alias("is")))
            entries = marked.groupBy(*columns).agg(F.sum("should").alias("should"), F.sum("is").alias("is"))
            counts = [F.sum("should").alias("expected"), F.sum(F.least("should", "is")).alias("found"), F.sum("is").alias("all")]
            faults = entries.groupBy("field").agg(*counts).filter("expected != found or found != all")
            out.append(faults.select(F.lit(v).alias("version"), F.lit("terms").alias("name"), "field", F.lit("terms").alias("problem"), "expected", "found"))
    for was, by in index._left_of(versions).items():
        ids = index._left(was, by, buckets)
        known = index.spark.read.parquet(index._table("documents", was)).select("doc_id")
        known = known.withColumn("known", F.lit(1)).dropDuplicates(["doc_id"])
        lost = ids.join(known, "doc_id", "left").agg(F.count("*").alias("expected"), F.count("known").alias("found"))
        out.append(lost.filter("expected != found").select(F.lit(was).alias("version"), F.lit("left").alias("name"), F.lit("").alias("field"), F.lit("left").alias("problem"), "expected", "found"))
    return out


def repair_kept_index(index: IndexFolder) -> list[tuple[int, str]]:
    """Make damaged postings, dictionaries and bounds anew from the fields of their version, and sum them again.

    Returns the (version, table) that cannot be made from what is there: documents, fields and ``left``, to be written again from
    the source. Postings are mended before dictionaries, from the first version on, as a dictionary counts what its
    version took from earlier ones.
    """
    faults = {(r.version, r["name"]) for r in check_kept_index(index).select("version", "name").distinct().collect()}
    lost = sorted(f for f in faults if f[1] not in DERIVED and f[1] != "sums")
    layout = index._layout()
    if layout is None or not faults:
        return lost
    whole = [v for v in index.versions() if (v, "fields") not in faults]
    for v in whole:
        if (v, "postings") in faults:
            stored = index.spark.read.schema(index._stored_schema("fields")).parquet(index._table("fields")).filter(F.col("version") == v).drop("version")
            index._write_postings(field_postings(written(stored, "fields").repartition(layout[0], "doc_id"), index.definition), v, *layout, dealt=True)
    mended = {v for v, name in faults if name in DERIVED | {"sums"}}
    later = {by for was, bys in index._left_of(index.versions()).items() if was in mended for by in bys}
    for v in sorted(mended | later):
        if v in whole:
            index._write_terms(v, layout[0])
            index.write_sums(v)
    return lost
