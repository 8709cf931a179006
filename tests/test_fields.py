"""Field rules: policies, sentinels, arrays, objects, companions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioscan.definition import (
    ALL_FIELDS,
    ANALYZED,
    ANALYZED_NO_NORMS,
    NOT_ANALYZED_NO_NORMS,
    NOT_INDEXED,
    IndexDefinition,
    Indexing,
    Sort,
    Storage,
)
from folioscan.operators import fields


def rows(spark, value, ddl, definition=IndexDefinition("t"), name="v"):
    source = spark.createDataFrame([("Doc", value)], f"id string, `{name}` {ddl}")
    return [r.asDict() for r in fields.field_rows(source, "id", definition).orderBy("field", "ord").collect()]


def terms(*args, **kwargs):
    return [(r["field"], r["ord"], r["term"]) for r in rows(*args, **kwargs)]


def raw(name="v", **more):
    return IndexDefinition("t", indexing={name: Indexing.NOT_ANALYZED}, **more)


def test_names(spark):
    assert terms(spark, "x", "string", name="9lives") == [("_9lives", 1, "x")]
    assert fields.field_name("_x") == "_x" and fields.field_name("Été") == "Été"
    for blank in ("", "  ", "\t"):
        with pytest.raises(ValueError):
            fields.field_name(blank)
    assert rows(spark, "x", "string")[0]["doc_id"] == "doc"


def test_policy_resolution():
    d = IndexDefinition(
        "t",
        indexing={"a": Indexing.NO, "b": Indexing.ANALYZED, "c": Indexing.NOT_ANALYZED, "d": Indexing.DEFAULT},
        storage={"a": Storage.YES},
        sorting={"n": Sort.LONG},
        analyzers={"e": "mine", "b2": "mine"},
    )
    modes = [d.index_mode(n, NOT_ANALYZED_NO_NORMS) for n in "abcdef"]
    assert modes == [
        NOT_INDEXED, ANALYZED_NO_NORMS, NOT_ANALYZED_NO_NORMS, NOT_ANALYZED_NO_NORMS, ANALYZED, NOT_ANALYZED_NO_NORMS,
    ]
    assert d.index_mode("d") == ANALYZED_NO_NORMS
    assert d.is_stored("a") and not d.is_stored("b") and d.is_stored("b", Storage.YES)
    assert (d.sort_of("n"), d.sort_of("n_Range"), d.sort_of("x")) == (Sort.LONG, Sort.LONG, Sort.NONE)
    everything = IndexDefinition("t", indexing={ALL_FIELDS: Indexing.ANALYZED}, sorting={ALL_FIELDS: Sort.INT})
    assert everything.index_mode("x", NOT_ANALYZED_NO_NORMS) == ANALYZED_NO_NORMS
    assert everything.sort_of("x_Range") is Sort.INT
    # Only a field's own entry chooses the word analyzer.
    assert everything.analyzer_of("x") == "lowercase_keyword"
    assert (d.analyzer_of("b"), d.analyzer_of("c"), d.analyzer_of("e")) == ("standard", "keyword", "lowercase_keyword")
    both = IndexDefinition("t", indexing={"a": Indexing.ANALYZED}, analyzers={"a": "not registered"})
    assert both.analyzer_of("a") == "lowercase_keyword"


def test_policy_frames_agree_with_the_definition(spark):
    d = IndexDefinition(
        "t",
        indexing={"a": Indexing.NO, "b": Indexing.ANALYZED, "d": Indexing.DEFAULT},
        storage={"a": Storage.YES, ALL_FIELDS: Storage.NO},
        sorting={"n": Sort.LONG, "m_Range": Sort.INT},
        analyzers={"e": "mine"},
    )
    names = ["a", "b", "c", "d", "e", "n", "n_Range", "m", "m_Range", "_Range"]
    frame = spark.createDataFrame([(n,) for n in names], "field string")
    for default in (ANALYZED_NO_NORMS, NOT_ANALYZED_NO_NORMS):
        found = {r.field: r.index_mode for r in fields.resolve_indexing(frame, d, default).collect()}
        assert found == {n: d.index_mode(n, default) for n in names}
    assert {r.field: r.stored for r in fields.resolve_storage(frame, d).collect()} == {n: d.is_stored(n) for n in names}
    assert {r.field: r["sort"] for r in fields.resolve_sort(frame, d).collect()} == {n: d.sort_of(n).value for n in names}


def test_sentinels(spark):
    for definition in (IndexDefinition("t"), raw(), IndexDefinition("t", indexing={"v": Indexing.NO})):
        for value, term, kind in ((None, "NULL_VALUE", "null"), ("", "EMPTY_STRING", "empty")):
            [row] = rows(spark, value, "string", definition)
            assert (row["term"], row["kind"], row["mode"], row["indexed"]) == (term, kind, "keyword", True)
    [real] = rows(spark, "NULL_VALUE", "string")
    assert (real["term"], real["kind"]) == ("NULL_VALUE", "text")
    [hidden] = rows(spark, "x", "string", IndexDefinition("t", indexing={"v": Indexing.NO}))
    assert not hidden["indexed"]


def test_raw_and_analysed_texts(spark):
    assert terms(spark, True, "boolean") == [("v", 1, "true")]
    assert terms(spark, True, "boolean", raw()) == [("v", 1, "True")]
    assert terms(spark, Decimal("1.50"), "decimal(12,2)") == [("v", 1, "1.5")]
    assert terms(spark, Decimal("1.50"), "decimal(12,2)", raw()) == [("v", 1, "1.50")]
    [analysed] = rows(spark, 7, "int", IndexDefinition("t", indexing={"v": Indexing.ANALYZED}))
    assert (analysed["mode"], analysed["num_long"]) == ("standard", 7)
    [plain] = rows(spark, 7, "int")
    assert plain["mode"] == "keyword"


def test_companions(spark):
    def companion(value, ddl, definition=IndexDefinition("t")):
        [r] = rows(spark, value, ddl, definition)
        return r["range_type"], r["num_long"], r["num_double"]

    assert companion(5, "int") == ("int", 5, None)
    assert companion(5, "int", IndexDefinition("t", sorting={"v": Sort.LONG})) == ("long", 5, None)
    assert companion(5, "bigint") == ("long", 5, None)
    assert companion(1.5, "float") == ("float", None, 1.5)
    assert companion(1.5, "float", IndexDefinition("t", sorting={"v": Sort.DOUBLE})) == ("double", None, 1.5)
    assert companion(1.5, "double") == ("double", None, 1.5)
    assert companion(Decimal("1.50"), "decimal(5,2)") == ("double", None, 1.5)
    for value, ddl in ((5, "smallint"), (5, "tinyint"), ("5", "string"), (True, "boolean")):
        assert companion(value, ddl) == (None, None, None)
    # Not analysed: no companion. Null: none either.
    assert companion(5, "int", raw()) == (None, None, None)
    assert companion(None, "int") == (None, None, None)


def test_arrays(spark):
    stored = IndexDefinition("t", storage={"v": Storage.YES})
    assert terms(spark, [], "array<string>", stored) == []
    assert terms(spark, ["a", None, "b"], "array<string>") == [("v", 1, "a"), ("v", 2, "b")]
    assert terms(spark, ["a", None, ""], "array<string>", raw()) == [
        ("v", 1, "a"), ("v", 2, "NULL_VALUE"), ("v", 3, "EMPTY_STRING"),
    ]
    # The marker comes with the first item, kept or not.
    assert terms(spark, [None], "array<string>", stored) == [("v_IsArray", 1, "true")]
    assert terms(spark, [[1], [2, 3]], "array<array<int>>", stored) == [
        ("v", 1, "1"), ("v", 2, "2"), ("v", 3, "3"), ("v_IsArray", 1, "true"),
    ]
    assert terms(spark, [["a"], None, ["b", None]], "array<array<string>>") == [("v", 1, "a"), ("v", 2, "b")]
    assert [t[2] for t in terms(spark, [["a"], None, ["b", None]], "array<array<string>>", raw())] == [
        "a", "NULL_VALUE", "b", "NULL_VALUE",
    ]
    assert terms(spark, [[[1], None], [[2]]], "array<array<array<int>>>") == [("v", 1, "1"), ("v", 2, "2")]
    # A missing array is a null value; default numbers drop null items as analysed fields do.
    assert terms(spark, None, "array<string>") == [("v", 1, "NULL_VALUE")]
    assert terms(spark, [1, None], "array<int>") == [("v", 1, "1")]
    assert [r["num_long"] for r in rows(spark, [4, 5], "array<int>")] == [4, 5]
    # A policy of No is not an analysed one, so its null items stay.
    hidden = IndexDefinition("t", indexing={"v": Indexing.NO})
    assert [r["kind"] for r in rows(spark, ["a", None], "array<string>", hidden)] == ["text", "null"]


def test_objects(spark):
    found = terms(spark, {"a": "b"}, "map<string,string>")
    assert found == [("v", 1, '{"a":"b"}'), ("v_ConvertToJson", 1, "true")]
    assert terms(spark, (1, "x"), "struct<n:int,s:string>", raw()) == [("v", 1, '{"n":1,"s":"x"}')]
    assert terms(spark, None, "struct<n:int>") == [("v", 1, "NULL_VALUE")]
    several = terms(spark, [(1,), None, (2,)], "array<struct<n:int>>")
    assert several == [("v", 1, '{"n":1}'), ("v", 2, '{"n":2}'), ("v_ConvertToJson", 1, "true"), ("v_ConvertToJson", 2, "true")]


def test_binary_is_refused(spark):
    for ddl in ("binary", "array<binary>"):
        with pytest.raises(ValueError):
            rows(spark, None, ddl)


def test_document_table(spark):
    d = IndexDefinition(
        "t",
        indexing={"body": Indexing.ANALYZED, "code": Indexing.NOT_ANALYZED, "hidden": Indexing.NO},
        storage={"hidden": Storage.YES},
    )
    data = [("A", "The Blue rod", "X1", "s", "Wide Name", 5, [1, 2]), ("B", "", None, None, "", None, None)]
    source = spark.createDataFrame(
        data, "id string, body string, code string, hidden string, title string, n int, ns array<bigint>"
    )
    a, b = fields.document_table(source, "id", d).orderBy("doc_id").collect()
    assert (a.doc_id, a.body, a.code, a.hidden, a.stored_hidden) == ("a", [None, "blue", "rod"], "X1", None, "s")
    assert (a.title, a.n, a.n_Range, a.ns, a.ns_Range) == ("wide name", "5", 5, ["1", "2"], [1, 2])
    assert (b.body, b.code, b.hidden, b.title) == (["EMPTY_STRING"], "NULL_VALUE", "NULL_VALUE", "EMPTY_STRING")
    assert (b.n, b.n_Range, b.ns, b.ns_Range) == ("NULL_VALUE", None, ["NULL_VALUE"], None)


def test_names_must_not_meet(spark):
    source = spark.createDataFrame([("A", 1, 2)], "id string, `9x` int, `_9x` int")
    with pytest.raises(ValueError):
        fields.document_table(source, "id", IndexDefinition("t"))


def test_one_scan_for_all_fields(spark, plan):
    source = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    text = plan(fields.field_rows(source, "p_partkey", IndexDefinition("t")))
    assert text.count("Scan parquet") == 2  # the tree and its details
    assert "Exchange" not in text and "Python" not in text


def test_dump(spark):
    source = spark.createDataFrame([("A", 5, None)], "id string, n int, s string")
    d = IndexDefinition("t", indexing={"s": Indexing.NO}, storage={"n": Storage.YES})
    [row] = fields.document_dump(source, "id", d).collect()
    assert row.dump == "\t__document_id IS: a\n\tn IS: 5\n\tn_Range IS: 5\n\ts I-: NULL_VALUE\n"


def test_ready_rows(spark):
    made = fields.field_rows(spark.createDataFrame([("A", "x")], "id string, v string"), "id", IndexDefinition("t"))
    ready = made.withColumn("field", F.lit("any name")).withColumn("term", F.lit("As Is"))
    assert {(r.field, r.term) for r in fields.with_ready_rows(made, ready).collect()} == {("v", "x"), ("any name", "As Is")}
