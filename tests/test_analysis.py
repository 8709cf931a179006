"""Analyzers, postings and term statistics against plain Python."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from folioscan.definition import STOP_WORDS, IndexDefinition, Indexing
from folioscan.functions import analysis
from folioscan.operators import fields
from folioscan.operators import postings as p

TEXTS = [
    "The quick-brown fox; the Ünï Code 42nd édition!",
    "",
    "  ...  ",
    "a",
    "the of and",
    "x" * 300 + " y " + "z9 " * 500,
    " ".join(f"w{i}, " for i in range(3000)),
    "日本語 text\nnew\tline's",
]


def expected(text, pattern, stops):
    found = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(pattern, text)]
    return [(i, s, e, w) for i, (s, e, w) in enumerate(found) if w not in stops]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").cache()


@pytest.mark.parametrize(
    ("mode", "pattern", "stops"),
    [("standard", r"[\p{L}\p{N}]+", STOP_WORDS), ("stop", r"\p{L}+", STOP_WORDS), ("simple", r"\p{L}+", ())],
)
def test_word_postings(docs, mode, pattern, stops):
    rows = p.text_postings(docs, F.col("id"), "text", F.col("text"), mode).collect()
    found = {(int(r.doc_id), r.pos, r.start_off, r.end_off, r.term) for r in rows}
    wanted = {(i, *e) for i, t in enumerate(TEXTS) for e in expected(t, pattern, stops)}
    assert found == wanted and len(rows) == len(wanted)
    bare = p.text_postings(docs, F.col("id"), "text", F.col("text"), mode, offsets=False)
    assert {(int(r.doc_id), r.pos, r.term) for r in bare.collect()} == {(i, w[0], w[3]) for i, *w in wanted}


def test_whole_value_postings(docs):
    for mode, form in (("keyword", str), ("lowercase_keyword", str.lower)):
        rows = p.text_postings(docs, F.col("id"), "text", F.col("text"), mode).collect()
        found = {(int(r.doc_id), r.pos, r.start_off, r.end_off, r.term) for r in rows}
        assert found == {(i, 0, 0, len(t), form(t)) for i, t in enumerate(TEXTS) if t}


def test_running_sums(spark):
    rng = random.Random(1)
    data = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 31, 32, 33, 1024, 1025, 5000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v array<int>")
    for row in rows.select("v", analysis.running_sums(F.col("v")).alias("s")).collect():
        assert row.s == [sum(row.v[: i + 1]) for i in range(len(row.v))]


def test_query_terms_agree_with_columns(spark):
    for mode in ("standard", "stop", "simple", "keyword", "lowercase_keyword"):
        for text in TEXTS[:5] + TEXTS[7:]:
            frame = spark.range(1).select(F.lit(text).alias("text"))
            rows = p.text_postings(frame, F.lit("d"), "f", F.col("text"), mode, offsets=False).collect()
            assert sorted((r.pos, r.term) for r in rows) == analysis.query_terms(text, mode, STOP_WORDS)


def test_per_field_modes(spark):
    d = IndexDefinition("t", indexing={"body": Indexing.ANALYZED, "code": Indexing.NOT_ANALYZED, "no": Indexing.NO})
    data = [("A", "The Rod", "X Y", "hidden", "Plain Text", None, 7)]
    source = spark.createDataFrame(data, "id string, body string, code string, no string, other string, gone string, n int")
    rows = p.field_postings(fields.field_rows(source, "id", d), d).collect()
    assert {(r.field, r.pos, r.start_off, r.end_off, r.term) for r in rows} == {
        ("body", 1, 4, 7, "rod"),
        ("code", 0, 0, 3, "X Y"),
        ("other", 0, 0, 10, "plain text"),
        ("gone", 0, 0, 10, "NULL_VALUE"),
        ("n", 0, 0, 1, "7"),
    }


def test_positions_run_through_values(spark):
    d = IndexDefinition("t", indexing={"words": Indexing.ANALYZED, "raw": Indexing.NOT_ANALYZED})
    values = ["blue x", None, "", "the y", "...", "rod"]
    source = spark.createDataFrame([("A", values, values)], "id string, words array<string>, raw array<string>")
    rows = p.field_postings(fields.field_rows(source, "id", d), d)
    found = sorted((r.field, r.ord, r.pos, r.term) for r in rows.collect())
    assert found == [
        ("raw", 1, 0, "blue x"), ("raw", 2, 1, "NULL_VALUE"), ("raw", 3, 2, "EMPTY_STRING"),
        ("raw", 4, 3, "the y"), ("raw", 5, 4, "..."), ("raw", 6, 5, "rod"),
        ("words", 1, 0, "blue"), ("words", 1, 1, "x"), ("words", 2, 2, "EMPTY_STRING"), ("words", 3, 4, "y"),
        ("words", 5, 5, "rod"),
    ]
    # Array places of the wide table are the same positions.
    [wide] = fields.document_table(source, "id", d).collect()
    assert wide.words == ["blue", "x", "EMPTY_STRING", None, "y", "rod"]
    for phrase, hit in (("x EMPTY_STRING", False), ("y rod", True), ("blue rod", False)):
        terms = analysis.query_terms(phrase, "standard", STOP_WORDS)
        assert bool(p.phrase_documents(rows.filter("field = 'words'"), terms).collect()) == hit


def test_custom_analyzer(spark):
    analysis.register_analyzer("by_comma", lambda text: F.split(text, ","))
    d = IndexDefinition("t", analyzers={"tags": "by_comma"})
    source = spark.createDataFrame([("A", "x,Y z")], "id string, tags string")
    rows = p.field_postings(fields.field_rows(source, "id", d), d).collect()
    assert [(r.pos, r.term) for r in rows] == [(0, "x"), (1, "Y z")]
    [wide] = fields.document_table(source, "id", d).collect()
    assert wide.tags == ["x", "Y z"]


def test_term_stats(spark, docs):
    counts = {}
    for i, text in enumerate(TEXTS):
        for _, _, _, word in expected(text, r"[\p{L}\p{N}]+", STOP_WORDS):
            counts.setdefault(word, []).append(i)
    wanted = {w: (len(set(ids)), len(ids)) for w, ids in counts.items()}
    straight = p.text_term_stats(docs, "text", F.col("text"))
    posted = p.posting_term_stats(p.text_postings(docs, F.col("id"), "text", F.col("text"), "standard", offsets=False))
    for stats in (straight, posted):
        assert {r.term: (r.doc_freq, r.total_freq) for r in stats.collect()} == wanted


def test_term_stats_shuffle_once(spark, plan, docs):
    text = plan(p.text_term_stats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text", F.col("text")))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1


def phrases(text, wanted):
    words = [m.group().lower() for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    first = wanted[0][0]
    return any(all(s + q - first < len(words) and words[s + q - first] == t for q, t in wanted) for s in range(len(words)))


@pytest.mark.parametrize("phrase", ["b c", "b b", "a the b", "c", "b b b", "b of b c", "nowhere b", "the"])
def test_phrases(spark, phrase):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["b", "c", "d", "the", "of"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    postings = p.text_postings(docs, F.col("id"), "text", F.col("text"), "standard", offsets=False)
    wanted = analysis.query_terms(phrase, "standard", STOP_WORDS)
    found = {int(r.doc_id) for r in p.phrase_documents(postings, wanted).collect()}
    assert found == ({i for i, t in enumerate(texts) if phrases(t, wanted)} if wanted else set())


def test_an_analyzer_for_documents_alone(spark, monkeypatch):
    from folioscan import IndexDefinition, Indexing
    from folioscan.operators import predicates as q

    monkeypatch.setattr(analysis, "_custom", {})
    monkeypatch.setattr(analysis, "_not_for_queries", set())
    definition = IndexDefinition("t", indexing={"a": Indexing.ANALYZED, "b": Indexing.ANALYZED, "c": Indexing.NOT_ANALYZED}, analyzers={"a": "halves"})
    for for_queries, mode in ((False, "lowercase_keyword"), (True, "halves")):
        analysis.register_analyzer("halves", lambda text: F.split(text, "-"), for_queries)
        field = q.search_field(definition, "a")
        assert field.multi and field.mode == mode and definition.analyzer_of("a") == "halves"
    assert [t for _, t in q.search_field(definition, "a").analyze("x-y")] == ["x", "y"]
    assert q.search_field(definition, "b").mode == "standard" and q.search_field(definition, "b").multi
    assert q.search_field(definition, "c").mode == "keyword" and not q.search_field(definition, "c").multi
