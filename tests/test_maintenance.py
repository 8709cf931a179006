"""Upserts, index folders, checks, compaction and streams."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.definition import IndexDefinition, Indexing, Storage
from folioscan.operators import maintenance, upsert
from folioscan.operators.index_store import IndexFolder
from folioscan.session import scratch_path
from folioscan.sources.tables import jdbc_options
from folioscan.streaming import upsert as streaming

DEFINITION = IndexDefinition(
    "t", indexing={"body": Indexing.ANALYZED, "tag": Indexing.NOT_ANALYZED}, storage={"tag": Storage.YES}
)
SCHEMA = "id string, body string, tag string, n int, seq bigint"


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_latest_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", i, f"v{i}") for i in range(2000)]
    rng.shuffle(rows)
    best = {}
    for k, s, v in rows:
        best[k] = max(best.get(k, (-1, "")), (s, v))
    frame = spark.createDataFrame(rows, "k string, s int, v string")
    assert as_set(upsert.latest(frame, "k", "s")) == {(k, *b) for k, b in best.items()}
    assert as_set(upsert.latest(frame.select("v", "s", "k"), "k", ["s", "v"])) == {(v, s, k) for k, (s, v) in best.items()}


def test_upsert(spark):
    current = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, s int, v string")
    batch = spark.createDataFrame([("b", 3, "x"), ("b", 5, "new"), ("c", 4, "new")], "k string, s int, v string")
    once = upsert.upsert(current, batch, "k", "s")
    assert as_set(once) == {("a", 1, "old"), ("b", 5, "new"), ("c", 4, "new")}
    assert as_set(upsert.upsert(once, batch, "k", "s")) == as_set(once)
    assert as_set(upsert.delete_by_id(once, spark.createDataFrame([("a",), ("a",)], "k string"), "k")) == {
        ("b", 5, "new"), ("c", 4, "new"),
    }


def test_snapshot(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, version int, v string")
    assert as_set(upsert.snapshot_as_of(log, "k", 0, "version")) == set()
    assert as_set(upsert.snapshot_as_of(log, "k", 2, "version")) == {("a", 1, "x"), ("b", 2, "z")}
    assert as_set(upsert.snapshot_as_of(log, "k", 3, "version")) == {("a", 3, "y"), ("b", 2, "z")}
    assert upsert.changed_since(log, 1).first().changed == 2


@pytest.fixture
def index(spark):
    folder = IndexFolder(spark, scratch_path(spark, "index"), DEFINITION)
    first = [("A", "the blue rod", "T1", 1, 1), ("B", "red ring", None, 2, 2), ("b", "red rod", "T2", 3, 3)]
    second = [("a", "green rod", "", 4, 4), ("C", "the", "T3", 5, 5)]
    folder.write(spark.createDataFrame(first, SCHEMA), "id", 1, "seq")
    folder.write(spark.createDataFrame(second, SCHEMA), "id", 2, "seq")
    return folder


def bodies(rows):
    return {(r.doc_id, r.term) for r in rows.collect()}


def test_index_folder(spark, index):
    now = {r.doc_id: (r.body, r.tag, r.stored_tag, r.n_Range) for r in index.documents().collect()}
    assert now == {
        "a": (["green", "rod"], "EMPTY_STRING", "", 4),
        "b": (["red", "rod"], "T2", "T2", 3),
        "c": ([None], "T3", "T3", 5),
    }
    assert {r.doc_id: r.tag for r in index.documents(1).collect()} == {"a": "T1", "b": "T2"}
    assert bodies(index.postings("body")) == {("a", "green"), ("a", "rod"), ("b", "red"), ("b", "rod")}
    assert bodies(index.postings("body", 1)) == {("a", "blue"), ("a", "rod"), ("b", "red"), ("b", "rod")}
    assert bodies(index.postings("tag")) == {("a", "EMPTY_STRING"), ("b", "T2"), ("c", "T3")}
    # Writing a version again changes nothing.
    before = as_set(index.postings().select("doc_id", "field", "term"))
    index.write(spark.createDataFrame([("a", "green rod", "", 4, 4), ("C", "the", "T3", 5, 5)], SCHEMA), "id", 2, "seq")
    assert as_set(index.postings().select("doc_id", "field", "term")) == before


def test_unfinished_versions_stay_unseen(spark, index):
    before = as_set(index.documents().select("doc_id", "tag"))
    index.documents().limit(1).drop("version").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{index.path}/documents/version=3"
    )
    assert index.versions() == [1, 2]
    assert as_set(index.documents().select("doc_id", "tag")) == before
    assert not index.write(spark.createDataFrame([], SCHEMA), "id", 3, "seq")


def test_search_filters_reach_the_scan_of_live_documents(index, plan):
    text = plan(index.documents().filter("tag = 'T2' and n_Range > 1"))
    assert "EqualTo(tag,T2)" in text and "GreaterThan(n_Range,1)" in text
    [row] = index.documents().filter("tag = 'T2' and n_Range > 1").collect()
    assert row.doc_id == "b"


def test_compaction_keeps_the_content(spark, index):
    compact = index.compact(scratch_path(spark, "compact"))
    for name in ("documents", "fields", "postings"):
        old, new = getattr(index, name)().drop("version"), getattr(compact, name)().drop("version")
        assert sorted(map(repr, as_set_rows(old))) == sorted(map(repr, as_set_rows(new.select(*old.columns))))


def as_set_rows(df):
    return [tuple(r) for r in df.collect()]


def test_postings_scan_is_pruned(index, plan):
    text = plan(index.postings("body").filter(col("term") == "rod"))
    assert "EqualTo(term,rod)" in text
    assert any("field" in part.splitlines()[0] for part in text.split("PartitionFilters")[1:])


def test_check_and_repair(spark):
    docs = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 1)], "doc_id string, seq int")
    posts = spark.createDataFrame(
        [("a", 0, 0, 2), ("b", 1, 5, 4), ("x", 0, 0, 1), ("x", 1, 2, 3), ("b", -1, 0, 1)],
        "doc_id string, pos int, start_off int, end_off int",
    )
    found = {r.check: r.bad_rows for r in maintenance.check_index(docs, posts).collect()}
    assert found == {"null_id": 1, "duplicate_id": 1, "orphan_posting": 2, "bad_span": 2}
    good = maintenance.repair_documents(docs, "seq")
    kept = maintenance.repair_postings(good, posts)
    assert as_set(good) == {("a", 2), ("b", 1)} and as_set(kept) == {("a", 0, 0, 2)}
    assert {r.bad_rows for r in maintenance.check_index(good, kept).collect()} == {0}
    empty = maintenance.check_index(docs.limit(0), posts.limit(0))
    assert {r.bad_rows for r in empty.collect()} == {0}


def test_repair_of_an_oversized_document(spark):
    docs = spark.range(20).select(col("id").cast("string").alias("doc_id"))
    posts = spark.range(9000).select(
        F.when(col("id") % 3 == 0, "7").otherwise((col("id") % 40).cast("string")).alias("doc_id"),
        col("id").cast("int").alias("pos"),
        F.lit(0).alias("start_off"),
        F.lit(1).alias("end_off"),
    )
    known = [str(i) for i in range(20)]
    wanted = posts.filter(col("doc_id").isin(*known)).count()
    assert maintenance.repair_postings(docs, posts).count() == wanted


def test_arrival_order_does_not_matter(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(9)}", s, f"v{s}") for s in range(200)]
    results = []
    for _ in range(2):
        rng.shuffle(rows)
        parts = [spark.createDataFrame(rows[i : i + 50], "k string, s int, v string") for i in range(0, 200, 50)]
        state = upsert.latest(parts[0], "k", "s")
        log = parts[0]
        for part in parts[1:]:
            log = log.unionByName(part)
        results.append(as_set(upsert.latest(log, "k", "s")))
        assert as_set(state) <= {tuple(r) for r in rows}
    assert results[0] == results[1]


def test_counters(spark):
    batch = spark.createDataFrame([("A",), ("a",), (None,), (" ",), ("b",)], "id string")
    counts = maintenance.ingest_stats(batch, "id").first().asDict()
    assert counts == {"attempts": 5, "successes": 3, "errors": 2, "docs_in": 5, "docs_out": 2}
    watched, observation = maintenance.observed_ingest(batch, "id")
    watched.write.format("noop").mode("overwrite").save()
    assert observation.get == {"attempts": 5, "successes": 3, "errors": 2}
    assert maintenance.ingest_stats(batch.limit(0), "id").first().asDict() == dict.fromkeys(counts, 0)


def test_batch_report(spark):
    rows = spark.range(2300).select(F.floor(col("id") / 1000).alias("batch"))
    assert as_set(maintenance.batch_report(rows)) == {(0, 1000, 1000), (1, 1000, 2000), (2, 300, 2300)}


def test_stream_keeps_one_state(spark):
    folder, sink, checkpoint = (scratch_path(spark, x) for x in ("in", "log", "progress"))
    rows = spark.range(600).select((col("id") % 7).alias("k"), col("id").alias("s"))
    for part in range(3):
        rows.filter(col("s") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
        progress = streaming.run_upserts(streaming.file_stream(spark, folder, rows.schema, files_per_batch=1), sink, checkpoint)
        assert sum(p["numInputRows"] for p in progress) == 200
    assert spark.read.parquet(sink).count() == 600
    current = streaming.current_documents(spark, sink, "k", "s")
    assert as_set(current) == as_set(upsert.latest(rows, "k", "s"))
    assert all(n >= 0 for _, n, _ in streaming.batch_rates(progress))


def test_stateful_form(spark):
    folder = scratch_path(spark, "in")
    rows = spark.range(300).select((col("id") % 7).alias("k"), col("id").alias("s"))
    rows.repartition(3).write.parquet(folder)
    stream = streaming.file_stream(spark, folder, rows.schema, files_per_batch=1)
    state = streaming.keyed_state(stream, "k", "s")
    query = state.writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert as_set(spark.table("state")) == as_set(upsert.latest(rows, "k", "s"))


def test_continuous_search(spark):
    folder, sink, checkpoint = (scratch_path(spark, x) for x in ("in", "hits", "progress"))
    rows = spark.range(100).select(col("id").alias("n"))
    rows.write.parquet(folder)
    stream = streaming.file_stream(spark, folder, rows.schema)
    query = streaming.start_search(stream, lambda d: d.filter(col("n") < 5), sink, checkpoint)
    query.processAllAvailable()
    query.stop()
    assert as_set(spark.read.parquet(sink)) == {(i,) for i in range(5)}


def test_jdbc_options():
    options = jdbc_options("jdbc:x", "t", partition_column="id", lower_bound=0, upper_bound=9, partitions=4, user="u")
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id" and options["user"] == "u"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id")
