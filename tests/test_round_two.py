"""Rules added to the kept index, values, literals and clauses."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan import IndexDefinition
from folioscan.functions import analysis, literals
from folioscan.functions.values import datetime_ticks, float_text, offset_datetime_text, value_text
from folioscan.operators import predicates as q
from folioscan.operators import ranking
from folioscan.operators.index_store import IndexFolder
from folioscan.operators.postings import phrase_documents
from folioscan.operators.upsert import latest, upsert
from folioscan.plans import QUERIES
from folioscan.session import scratch_path


@pytest.fixture
def index(spark):
    return IndexFolder(spark, scratch_path(spark, "index-test"), IndexDefinition("t"))


def test_columns_of_all_versions_stay(spark, index):
    index.write(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, t string, n int"), "id", 1)
    index.write(spark.createDataFrame([("B", "z", 1 << 40, "new")], "id string, t string, n long, extra string"), "id", 2)
    for folder in (index, index.compact(scratch_path(spark, "compact-test"))):
        rows = {r.doc_id: (r.t, r.n_Range, r.extra) for r in folder.documents().collect()}
        assert rows == {"a": ("x", 1, None), "b": ("z", 1 << 40, "new")}
        assert {(r.field, r.term) for r in folder.postings().collect()} >= {("extra", "new"), ("t", "x"), ("t", "z")}
    with pytest.raises(ValueError, match="in one version"):
        index.write(spark.createDataFrame([("c", 1.5)], "id string, n double"), "id", 3)


def test_versions_are_not_replaced(spark, index):
    rows = spark.createDataFrame([("a", "x")], "id string, t string")
    assert index.write(rows, "id", 1, batch_id="first")
    assert not index.write(rows, "id", 1, batch_id="first")
    for other in ("second", None):
        with pytest.raises(ValueError, match="already"):
            index.write(rows, "id", 1, batch_id=other)


def test_ids_are_unique_and_not_null(spark, index):
    with pytest.raises(ValueError, match="several"):
        index.write(spark.createDataFrame([("A", "x"), ("a", "y")], "id string, t string"), "id", 1)
    for seq in (None, "t"):
        with pytest.raises(ValueError, match="null id"):
            index.write(spark.createDataFrame([(None, "x")], "id string, t string"), "id", 1, seq=seq)


def test_files_follow_the_fields(spark, index):
    index.write(spark.range(3000).repartition(24).select("id", F.lit("x").alias("t"), F.lit(1).alias("n")), "id", 1)
    assert len(index.fields().inputFiles()) <= 3 * 8


def test_latest_keeps_rows_without_an_order(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {r.k: r.v for r in latest(rows, "k", "seq").collect()} == {"a": "x", "b": "z"}
    after = upsert(rows.filter("k = 'b'"), rows.filter("k = 'a'").withColumn("k", F.lit("b")), "k", "seq")
    assert [(r.k, r.v) for r in after.collect()] == [("b", "x")]


def test_small_numbers_keep_their_digits(spark):
    values = [1.2345678901234567e-4, 2.5000000001234567e-5, -9.999999999999999e-4, 1e-4, 1e-5, 0.001, 123456789012345.6]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v")).alias("t")).collect()
    assert all(float(r.t) == r.v and "E" not in r.t for r in rows)


def test_decoders_agree(spark):
    texts = ["0x0x123456", "0x+1234567", "Ix\u0663", "Dx1.5d", "Dx1.5f", "Fx1e39", "Dx1e999", "Ix+5", "Dx.5", "Dx5.", "Ix 5", "Fx3.4e38", "0xFFFFFFFF", "Dxnan"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", literals.decode_column(F.col("t")).alias("n")).collect()
    for r in found:
        try:
            kind = literals.decode(r.t).kind
        except ValueError:
            kind = "error"
        assert r.n.kind == kind, r.t


def test_clauses(spark):
    docs = spark.createDataFrame([(1, [1, 9]), (2, [4, 5]), (3, None)], "doc_id int, n array<int>")
    field = q.SearchField("n", multi=True)
    assert [r.doc_id for r in docs.filter(q.range_clause(field, "Ix4", "Ix6", companion="n")).collect()] == [2]
    assert docs.filter(q.must()).count() == 3 and docs.filter(q.should()).count() == 0
    words = q.SearchField("w")
    many = spark.range(5000).select(F.col("id").cast("string").alias("w"))
    assert many.filter(q.any_of_terms(words, [str(i) for i in range(3000)])).count() == 3000
    empty, none = ranking.boolean(), ranking.boolean(must_not=[F.col("doc_id") == 1])
    assert docs.filter(empty.matches).count() == 0 and docs.filter(none.matches).count() == 2
    optional = ranking.boolean(should=[ranking.constant(F.col("doc_id") > 1), ranking.constant(F.col("doc_id") > 2, 3.0)])
    assert {r.doc_id: r.s for r in docs.filter(optional.matches).select("doc_id", optional.score.alias("s")).collect()} == {2: 0.5, 3: 4.0}


def test_repeated_postings_do_not_complete_a_phrase(spark):
    rows = spark.createDataFrame([("a", "x", 0), ("a", "x", 0), ("b", "x", 0), ("b", "y", 1)], "doc_id string, term string, pos int")
    assert [r.doc_id for r in phrase_documents(rows, [(0, "x"), (1, "y")]).collect()] == ["b"]


def test_custom_analyzer_reads_search_text(spark, monkeypatch):
    monkeypatch.setitem(analysis._custom, "commas", lambda text: F.split(text, ","))
    assert analysis.query_terms("a,b", "commas") == [(0, "a"), (1, "b")]


def test_times_do_not_depend_on_the_session_zone(spark):
    moments = [datetime(2024, 1, 1), datetime(2024, 3, 10, 2, 30, 0, 5), datetime(2024, 11, 3, 6, 30), datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999999)]
    expected = [(m.isoformat(timespec="microseconds") + "0", (m - datetime(1, 1, 1)) // timedelta(microseconds=1) * 10) for m in moments]
    rows = [(m.isoformat(),) for m in moments]
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    df = session.createDataFrame(rows, "s string").withColumn("local", F.col("s").cast("timestamp_ntz"))
    df = df.withColumn("zoned", F.concat("s", F.lit("Z")).cast("timestamp"))
    local, zoned, offset = F.col("local"), F.col("zoned"), F.lit("+00:00")
    found = df.select(
        value_text(local, T.TimestampNTZType()), datetime_ticks(local), value_text(zoned, T.TimestampType()), datetime_ticks(zoned),
        offset_datetime_text(local, offset, keep_offset=False), value_text(local.cast("date"), T.DateType()),
    ).collect()
    assert [tuple(r) for r in found] == [(text, n, text + "Z", n, text + "Z", text[:10] + "T00:00:00.0000000") for text, n in expected]


def test_values_of_fields_with_several_terms(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "b"]), (3, []), (4, None)], "doc_id int, w array<string>")
    values = spark.createDataFrame([("b",), ("b",), (None,)], "value string")
    found = q.matching_values(docs, q.SearchField("w", multi=True), values)
    assert sorted(r.doc_id for r in found.collect()) == [1, 2]


def test_dictionary_counts(spark, index):
    index.write(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, t string"), "id", 1)
    index.write(spark.createDataFrame([("b", "x")], "id string, t string"), "id", 2)
    compacted = index.compact(scratch_path(spark, "compact-test"))
    counts = [{r.term: (r.doc_freq, r.total_freq) for r in i.terms("t").collect()} for i in (index, compacted)]
    assert counts == [{"x": (3, 3)}, {"x": (3, 3)}]
    assert index.terms("t", version=1).filter("term = 'x'").head().doc_freq == 2
    near = q.fuzzy_documents(index.postings("t"), "y", 0.5, terms=index.terms("t"))
    assert near.count() == 0


@pytest.mark.parametrize("name", ["score_tfidf", "q_phrase", "q_fuzzy_terms"])
def test_searches_read_stored_postings(spark, plan, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "regexp" not in text and "documents.parquet" not in text
    assert re.search(r"PartitionFilters: .*field.* = text", text)
    if name != "q_fuzzy_terms":
        assert "In(term" in text
