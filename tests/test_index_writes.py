"""How an index version is written: rows dealt once, earlier postings not sorted, small files."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan import IndexDefinition, Indexing
from folioscan.functions.analysis import running_sums
from folioscan.operators.index_store import IndexFolder
from folioscan.session import scratch_path, settings

TEXTS = IndexDefinition("texts", indexing={"body": Indexing.ANALYZED})


@pytest.fixture
def index(spark):
    return IndexFolder(spark, scratch_path(spark, "writes"), TEXTS, buckets=4)


def rows(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "id string, body string")


def test_postings_are_made_where_the_fields_lie(spark, index, plan, monkeypatch):
    plans = []
    write = IndexFolder._write_postings
    monkeypatch.setattr(IndexFolder, "_write_postings", lambda self, postings, *a, **k: (plans.append(plan(postings)), write(self, postings, *a, **k)))
    assert index.write(rows(spark, {f"D{i}": "blue the rod" for i in range(20)}), "id", 1)
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Bucketed: true" in plans[0]
    assert sorted((r.doc_id, r.pos, r.term) for r in index.postings("body").collect()) == sorted((f"d{i}", p, t) for i in range(20) for p, t in ((0, "blue"), (2, "rod")))
    # The buckets of documents hold all postings of theirs.
    files = index.postings("body").select("doc_id", F.input_file_name().alias("file")).distinct()
    assert files.count() == 20 and {r.field for r in index.fields().collect()} == {"body"}


def test_earlier_postings_are_not_sorted_to_count_what_went(spark, index, plan):
    index.write(rows(spark, {f"d{i}": "blue rod" for i in range(20)}), "id", 1)
    index.write(rows(spark, {"d1": "red", "d2": "red rod"}), "id", 2)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        changes = index.term_changes(2, 4)
        text = plan(changes)
        assert "ShuffledHashJoin LeftSemi" in text and "SortMergeJoin" not in text
        assert {(r.term, r.doc_freq, r.total_freq) for r in changes.collect()} == {("blue", -2, -2), ("rod", -1, -1), ("red", 2, 2)}


def test_kept_files_are_compressed_well(spark, index):
    index.write(rows(spark, {"a": "blue rod", "b": "red"}), "id", 1)
    for kept in (index.documents(), index.fields(), index.postings(), index.terms()):
        assert kept.inputFiles() and all(".zstd" in f for f in kept.inputFiles())


def test_compaction_goes_bucket_by_bucket(spark, index, plan, monkeypatch):
    """No shuffle of postings, one file for each bucket and field, and all that is rewritten compressed well."""
    index.write(rows(spark, {f"d{i}": "blue the rod" for i in range(40)}), "id", 1)
    index.write(rows(spark, {f"d{i}": "red rod" for i in range(9)}), "id", 2)
    index.write(rows(spark, {f"d{i}": "green" for i in range(5, 12)}), "id", 3)
    index.delete(spark.createDataFrame([("d0",), ("d30",)], "id string"), "id", 4)
    index.write(rows(spark, {"d0": "again"}), "id", 5)
    saved = []
    save = IndexFolder._save
    monkeypatch.setattr(IndexFolder, "_save", lambda self, rows, name, v, b, p, o, dealt=False: (saved.append((name, dealt, plan(rows))), save(self, rows, name, v, b, p, o, dealt)))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        compacted = index.compact(scratch_path(spark, "compacted"))
    assert [(name, dealt) for name, dealt, _ in saved] == [("postings", True)] and "Exchange" not in saved[0][2] and "SortMergeJoin" not in saved[0][2]
    bodies = {f"d{i}": "green" if 5 <= i < 12 else "red rod" if i < 9 else "blue the rod" for i in range(40) if i != 30} | {"d0": "again"}
    expected = sorted((d, p, t) for d, body in bodies.items() for p, t in enumerate(body.split()) if t != "the")
    for folder in (index, compacted):
        assert sorted((r.doc_id, r.pos, r.term) for r in folder.postings("body").collect()) == expected
        assert sorted((r.doc_id, r.term) for r in folder.fields().collect()) == sorted(bodies.items())
        assert sorted(r.doc_id for r in folder.documents().collect()) == sorted(bodies)
    assert len(compacted.postings().inputFiles()) <= 4
    for kept in (compacted.documents(), compacted.fields(), compacted.postings(), compacted.terms()):
        assert kept.inputFiles() and all(".zstd" in f for f in kept.inputFiles())


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ValueError), settings(spark, {"spark.sql.shuffle.partitions": "3", "folioscan.none": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise ValueError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("folioscan.none", None) is None


def test_running_sums_of_any_length(spark):
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 256, 257, 5000):
        values = [rng.randrange(9) for _ in range(n)]
        found = spark.createDataFrame([(values,)], "v array<int>").select(running_sums(F.col("v")).alias("s")).first().s
        assert found == [sum(values[: i + 1]) for i in range(n)]
