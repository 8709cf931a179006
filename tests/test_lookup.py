"""Terms by pattern and by likeness, kept searches, and compaction by several columns."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscan.operators import predicates as q
from folioscan.operators.postings import text_term_stats
from folioscan.operators.stored_searches import StoredSearches, named_term
from folioscan.operators.term_lookup import GramTable, VariantTable, documents_with, pattern_grams, shortened, shortened_text
from folioscan.operators.zorder import interleaved, zorder_compacted
from folioscan.plans import QUERIES
from folioscan.session import scratch_path, settings

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dictionary(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    terms = text_term_stats(docs, "text", F.col("text")).select("term")
    odd = ["", "a", "ab", "abc", "été", "a*b", "x.y", "l" * 40, "l" * 31 + "mn", "l" * 33, None]
    return terms.union(spark.createDataFrame([(t,) for t in odd], "term string")).distinct().cache()


@pytest.fixture(scope="module")
def grams(spark, dictionary):
    return GramTable(spark, scratch_path(spark, "grams")).write(dictionary)


@pytest.fixture(scope="module")
def variants(spark, dictionary):
    return VariantTable(spark, scratch_path(spark, "variants")).write(dictionary)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_patterns_by_triples(dictionary, grams, plan):
    known = dictionary.filter("term is not null and term != ''")
    for pattern in ("*ther*ng", "?here*", "*ing", "th*", "the", "*e*t*", "a?c", "*", "*été*", "a", "?", "*x.y", "nothing-like-it*", "l" * 40 + "*"):
        expected = ids(known.filter(F.col("term").rlike(q.wildcard_regex(pattern))))
        found = grams.matching(pattern, dictionary.filter("term is not null and term != ''"))
        assert ids(found) == expected, pattern
        if pattern_grams(pattern):
            text = plan(grams.matching(pattern))
            assert "gram" in re.search(r"PushedFilters: \[([^]]*)\]", text)[1] and "InMemory" not in text.replace("InMemoryFileIndex", "")
    with pytest.raises(ValueError, match="dictionary"):
        grams.matching("*e*")


def test_likeness_by_variants(dictionary, variants, plan):
    some = [r.term for r in dictionary.filter("length(term) between 3 and 9").orderBy(F.xxhash64("term")).limit(6).collect()]
    for wanted in [*some, "thering", "a", "l" * 32, "l" * 34, "l" * 40, "zzzzzzz"]:
        for similarity, prefix in ((0.8, 0), (0.7, 2), (0.5, 0)):
            expected = ids(dictionary.filter(q.fuzzy_term(F.col("term"), wanted, similarity, prefix)))
            assert ids(variants.near(wanted, similarity, prefix, terms=dictionary)) == expected, (wanted, similarity)
    text = plan(variants.near("thering", 0.7))
    assert "variant" in re.search(r"PushedFilters: \[([^]]*)\]", text)[1]
    with pytest.raises(ValueError, match="edits"):
        variants.near("something", 0.1)


def test_variants_take_about_a_row_a_letter(spark, dictionary, variants):
    letters = dictionary.filter("term is not null and term != '' and length(term) <= 32").agg(F.sum(F.length("term") + 2)).first()[0]
    assert spark.read.parquet(variants.path).filter("variant is not null").count() <= letters


def test_searches_meet_documents_without_a_shuffle(spark, plan, monkeypatch):
    """No shuffle of what meets; the same answers when searches take several passes; ids that repeat."""
    clause = [("f", "a"), ("f", "b")]
    searches = [(i, clause[: 1 + i % 2], [("f", "c")] if i % 3 == 0 else None, [("n", i, None)]) for i in range(12)]
    kept = StoredSearches(spark, scratch_path(spark, "searches")).write(spark.createDataFrame(searches, SEARCHES), spark.createDataFrame([], "field string, term string, doc_freq bigint"))
    rows = [(f"d{i}", [f"f\x01{t}" for t in "abc"[: 1 + i % 3]], {"n": i}) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, terms array<string>, numbers map<string,bigint>")
    answers = sorted((s, f"d{d}") for s, must, none, _ in searches for d in range(20) if len(must) <= 1 + d % 3 and not (none and d % 3 == 2) and d >= s)
    found = kept.matches(docs, numbers="numbers")
    assert "Exchange hashpartitioning" not in plan(found) and "Exchange (" not in plan(found).replace("BroadcastExchange (", "")
    assert sorted(map(tuple, found.collect())) == answers and len(answers) > 20
    monkeypatch.setattr("folioscan.operators.stored_searches.AT_ONCE", 5)
    assert sorted(map(tuple, kept.matches(docs, numbers="numbers").collect())) == answers
    twice = sorted(map(tuple, kept.matches(docs.union(docs.filter("doc_id = 'd9'")), numbers="numbers").collect()))
    assert twice == sorted(answers + [a for a in answers if a[1] == "d9"] * 3)


def test_checks_of_searches_are_compiled(spark, plan, monkeypatch):
    """What meets is checked by generated code that Java compiles; in any number of passes, and with lists longer than are checked in line."""
    clause = [("f", f"w{i}") for i in range(6)]
    searches = [(i, clause[: 1 + i % 2], clause[2:3] if i % 3 else None, [("n", i, None)]) for i in range(12)]
    kept = StoredSearches(spark, scratch_path(spark, "searches")).write(spark.createDataFrame(searches, SEARCHES), spark.createDataFrame([], "field string, term string, doc_freq bigint"))
    rows = [(i, [f"f\x01w{j}" for j in range(1 + i % 3)] + ([None] if i == 9 else []), {"n": i}) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>, numbers map<string,bigint>")
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        found = kept.matches(docs, numbers="numbers")
        assert re.search(r"BroadcastHashJoin \[codegen id : \d+\]", plan(found))
        code = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    answers = sorted((s, d) for s, must, none, _ in searches for d in range(20) if len(must) <= 1 + d % 3 and not (none and (d % 3 == 2 or d == 9)) and d >= s)
    assert sorted(map(tuple, found.collect())) == answers and len(answers) > 20
    monkeypatch.setattr("folioscan.operators.stored_searches.AT_ONCE", 2)
    monkeypatch.setattr("folioscan.operators.stored_searches.TOGETHER", 4)
    found = kept.matches(docs, numbers="numbers")
    assert plan(found).count("BroadcastHashJoin") == 0 and sorted(map(tuple, found.collect())) == answers
    # One search of six terms, and a term that is null or has the name of a number.
    odd = [(0, clause, clause[:0], None), (1, clause, [("f", "x")], None), (2, [("f", "w0"), ("f", None)], None, None), (3, clause[:1], [(None, "x")], None)]
    kept = StoredSearches(spark, scratch_path(spark, "searches")).write(spark.createDataFrame(odd, SEARCHES), spark.createDataFrame([], "field string, term string, doc_freq bigint"))
    rows = [(i, [f"f\x01w{j}" for j in range(4 + i)], {}) for i in range(4)] + [(9, [f"f\x01{w}" for w in "w0 w1 w2 w3 w4 w5 x".split()], {})]
    found = kept.matches(spark.createDataFrame(rows, "doc_id long, terms array<string>, numbers map<string,bigint>"), numbers="numbers")
    assert sorted(map(tuple, found.collect())) == [(0, 2), (0, 3), (0, 9), (1, 2), (1, 3)]


def test_every_document_is_a_search(spark):
    """Also documents whose id is no multiple of 50 are kept as searches."""
    folder = scratch_path(spark, "asked")
    rows = [(7, "red cat sat", 11), (50, "red cat", 7), (51, "cat of red", 10), (53, "dog", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    found = {tuple(r) for r in QUERIES["stored_searches"](spark, folder).select("search_id", "doc_id").collect()}
    assert found == {("7", "50"), ("7", "51"), ("50", "7"), ("50", "50"), ("50", "51"), ("51", "7"), ("51", "50"), ("51", "51")}


def test_texts_with_letters_left_out(spark):
    for text in ("", "a", "abca", "wörd"):
        for letters in (0, 1, 2):
            found = spark.range(1).select(shortened(F.lit(text), letters)).first()[0]
            assert len(found) == len(set(found)) and set(found) == shortened_text(text, letters)


def test_documents_with_terms(spark):
    postings = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", "x")], "doc_id string, term string")
    assert ids(documents_with(postings, spark.createDataFrame([("x",)], "term string"))) == ["a", "c"]


CLAUSE = "array<struct<field:string,term:string>>"
SEARCHES = f"search_id long, must {CLAUSE}, must_not {CLAUSE}, ranges array<struct<field:string,low:bigint,high:bigint>>"


def test_kept_searches_against_each_document(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"d{i}", sorted({f"f\x01{w}" for w in rng.choices(words, k=5)}), {"n": i % 9} if i % 4 else {}) for i in range(60)]
    docs += [("none", [], {}), ("null", None, None)]
    searches = []
    for i in range(200):
        must = [("f", w) for w in rng.choices(words, k=rng.randint(0, 3))] + ([("g", "w1")] if i % 50 == 0 else [])
        ranges = [("n", rng.choice([None, rng.randint(0, 5)]), rng.choice([None, rng.randint(3, 9)]))] if i % 3 == 0 or not must else []
        searches.append((i, must or None, [("f", rng.choice(words))] if i % 2 else None, ranges or None))
    stats = spark.createDataFrame([("f", w, n) for n, w in enumerate(words[:-2])], "field string, term string, doc_freq bigint")
    kept = StoredSearches(spark, scratch_path(spark, "searches")).write(spark.createDataFrame(searches, SEARCHES), stats)
    batch = spark.createDataFrame(docs, "id string, terms array<string>, numbers map<string,bigint>")
    found = sorted(tuple(r) for r in kept.matches(batch, "id", numbers="numbers").collect())

    def answers(search, doc):
        _, must, must_not, ranges = search
        terms, numbers = set(doc[1] or []), doc[2] or {}
        inside = all(f in numbers and (lo is None or numbers[f] >= lo) and (hi is None or numbers[f] <= hi) for f, lo, hi in ranges or [])
        return inside and all(f"{f}\x01{t}" in terms for f, t in must or []) and not any(f"{f}\x01{t}" in terms for f, t in must_not or [])

    assert found == sorted((s[0], d[0]) for s in searches for d in docs if answers(s, d)) and len(found) > 100
    keys = spark.read.parquet(kept.path).select("key", F.transform("must", lambda t: t).alias("must")).collect()
    assert all(r.key in r.must or not r.must for r in keys)
    with pytest.raises(ValueError, match="requires nothing"):
        StoredSearches(spark, scratch_path(spark, "searches")).write(spark.createDataFrame([(1, None, [("f", "x")], None)], SEARCHES), stats)
    out = scratch_path(spark, "matches")
    for _ in range(2):  # a round that Spark repeats
        kept.write_matches(batch, out, 7, doc_id="id", numbers="numbers")
    assert spark.read.parquet(out).count() == len(found)
    assert spark.range(1).select(named_term(F.lit("f"), F.lit("t"))).first()[0] == "f\x01t"


def groups_read(path, column, low, high):
    """Row groups of a Parquet folder whose range of a column meets a filter."""
    read = total = 0
    for file in pq.ParquetDataset(path).files:
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = next(meta.row_group(g).column(c).statistics for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == column)
            total += 1
            read += stats.min <= high and stats.max >= low
    return read, total


def test_row_groups_are_left_out_for_either_column(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() ** 4 * 1000, rng.randint(0, 999), "x") for i in range(40_000)] + [(-1, None, None, "y"), (-2, 5.0, None, "y")] + [(-3, 7.0, 500, "z")] * 500
    table = spark.createDataFrame(rows, "id long, price double, amount int, note string").repartition(6)
    folders = {name: scratch_path(spark, name) for name in ("plain", "first", "both")}
    table.write.parquet(folders["plain"])
    table.repartitionByRange(32, "price").sortWithinPartitions("price").write.parquet(folders["first"])
    zorder_compacted(table, ["price", "amount"], partitions=32).write.parquet(folders["both"])
    assert spark.read.parquet(folders["both"]).exceptAll(table).isEmpty() and spark.read.parquet(folders["both"]).count() == len(rows)
    read = {name: (groups_read(path, "price", 100, 110), groups_read(path, "amount", 100, 110)) for name, path in folders.items()}
    assert read["plain"][0][0] == read["plain"][0][1]
    assert read["first"][1][0] == read["first"][1][1]
    for found, total in read["both"]:
        assert found <= 0.5 * total


def test_interleaved_bits(spark):
    found = spark.createDataFrame([(0b101, 0b011)], "a long, b long").select(interleaved([F.col("a"), F.col("b")], 3)).first()[0]
    assert found == 0b011011
    with pytest.raises(ValueError):
        zorder_compacted(spark.range(3), [])
