"""Predicates, scores, sorts, pages and numbering."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from folioscan.definition import Sort
from folioscan.operators import postings as p
from folioscan.operators import predicates as q
from folioscan.operators import ranking
from folioscan.sources import paging

NAMES = ["blue rod", "blue ring", "red ring", "", None, "NULL_VALUE", "b.ue (x)", "blu\\e*", "new\nline", "ROD"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, n, [w for w in (n or "").split(" ") if w], i - 3 if i % 4 else None) for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "id int, name string, words array<string>, n int").cache()


NAME = q.SearchField("name")
RAW = q.SearchField("name", "keyword")
WORDS = q.SearchField("words", "standard", multi=True)


def ids(docs, clause):
    return {r.id for r in docs.filter(clause).collect()}


def test_terms_and_booleans(docs):
    everything = set(range(len(NAMES)))
    blue, ring = q.prefix(NAME, "BLUE"), q.wildcard(NAME, "*ring")
    assert ids(docs, blue) == {0, 1} and ids(docs, ring) == {1, 2}
    assert ids(docs, q.must(blue, ring)) == {1} and ids(docs, q.should(blue, ring)) == {0, 1, 2}
    assert ids(docs, q.must_not(blue)) == everything - {0, 1}
    assert ids(docs, q.match_all()) == everything and ids(docs, q.match_none()) == set()
    assert ids(docs, q.term(RAW, "ROD")) == {9} and ids(docs, q.term(WORDS, "ring")) == {1, 2}
    assert ids(docs, q.any_of_terms(RAW, ["ROD", "red ring"])) == {2, 9}
    assert ids(docs, q.any_of_terms(WORDS, ["red", "rod"])) == {0, 2}
    assert ids(docs, q.is_null(RAW)) == {5}
    assert ids(docs, q.exists(NAME)) == everything - {3, 4} and ids(docs, q.exists(WORDS)) == everything - {3, 4}


def test_wildcards(docs):
    assert ids(docs, q.wildcard(NAME, "blue r?d")) == {0}
    assert ids(docs, q.wildcard(NAME, "b.ue*")) == {6} and ids(docs, q.wildcard(NAME, "*(x)")) == {6}
    assert ids(docs, q.wildcard(NAME, "new?line")) == {8} and ids(docs, q.wildcard(NAME, "?lu\\e*")) == {7}
    assert ids(docs, q.wildcard(RAW, "R*")) == {9} and ids(docs, q.wildcard(WORDS, "R?ng")) == {1, 2}
    assert ids(docs, q.wildcard(NAME, "*")) == ids(docs, q.exists(NAME))
    assert ids(docs, q.wildcard(NAME, "blue rod")) == {0}
    with pytest.raises(ValueError):
        q.wildcard(NAME, "")
    with pytest.raises(ValueError):
        q.wildcard(WORDS, "two w*")


def test_prefixes(docs):
    assert ids(docs, q.phrase_prefix(NAME, "Blue R*")) == {0, 1}
    assert ids(docs, q.field_text(NAME, "Blue Ri*")) == {1}
    assert ids(docs, q.field_text(NAME, "blu\\e*")) == {7}  # no blank: a plain term
    assert ids(docs, q.prefix(WORDS, "RI")) == {1, 2}
    for text in ("two words", "", "the"):
        with pytest.raises(ValueError):
            q.prefix(WORDS, text)


def test_free_text(docs):
    assert ids(docs, q.field_text(NAME, "Blue ROD")) == {0} and ids(docs, q.field_text(WORDS, "Red")) == {2}
    assert ids(docs, q.field_text(WORDS, "blue ring!")) == {1} and ids(docs, q.field_text(WORDS, "ring blue")) == set()
    assert ids(docs, q.field_text(WORDS, "the")) == set() and ids(docs, q.field_text(NAME, "")) == set()
    literals = q.LiteralTerms()
    token = literals.register("name", "ROD")
    literals.leave_alone("name", "NULL_VALUE")
    assert ids(docs, q.field_text(NAME, token, literals)) == {9}
    assert ids(docs, q.field_text(NAME, "NULL_VALUE", literals)) == {5}
    assert ids(docs, q.field_text(NAME, "NULL_VALUE")) == set()
    assert literals.lookup("other", token) is None


@pytest.mark.parametrize("text", ["b c", "b b", "b the c", "b the of c b", "c", "b b b b"])
def test_phrase_column(spark, text):
    rng = random.Random(11)
    stops = {"the", "of"}
    texts = [[rng.choice(["b", "c", "the", "of", "bb"]) for _ in range(rng.randrange(9))] for _ in range(400)]
    docs = spark.createDataFrame([(i, [None if w in stops else w for w in t]) for i, t in enumerate(texts)], "id int, words array<string>")
    wanted = [(i, w) for i, w in enumerate(text.split()) if w not in stops]

    def holds(t):
        return any(all(s + p < len(t) and t[s + p] == w for p, w in wanted) for s in range(len(t)))

    assert ids(docs, q.field_text(WORDS, text)) == {i for i, t in enumerate(texts) if holds(t)}


def test_phrase_of_odd_terms(spark):
    docs = spark.createDataFrame([(1, ["a.b", None, "c+"]), (2, ["axb", "x", "c+"]), (3, [])], "id int, words array<string>")
    assert ids(docs, q.phrase(WORDS, [(0, "a.b"), (2, "c+")])) == {1}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("wanted", "least", "shared"), [("ring", 0.5, 0), ("ring", 0.0, 0), ("ringer", 0.6, 2), ("r", 0.5, 0)])
def test_fuzzy(spark, wanted, least, shared):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ring") for _ in range(rng.randrange(1, 8))) for _ in range(400)})
    docs = spark.createDataFrame([(w, i % 50) for i, w in enumerate(words)], "name string, id int")

    def near(w):
        close = 1 - distance(w, wanted) / min(len(w), len(wanted)) > least + 1e-12
        return close and w.startswith(wanted[:shared])

    found = {r.name for r in docs.filter(q.fuzzy(NAME, wanted.upper(), least, shared)).collect()}
    assert found == {w for w in words if near(w)}
    postings = docs.select(col("id").cast("string").alias("doc_id"), col("name").alias("term"))
    hits = {int(r.doc_id) for r in q.fuzzy_documents(postings, wanted, least, shared).collect()}
    assert hits == {i % 50 for i, w in enumerate(words) if near(w)}


def test_ranges(docs):
    n = q.SearchField("n")
    numbers = {i: i - 3 for i in range(len(NAMES)) if i % 4}
    assert ids(docs, q.range_clause(n, "Ix-1", "Ix2")) == {i for i, v in numbers.items() if -1 <= v <= 2}
    assert ids(docs, q.range_clause(n, "Ix-1", "Ix2", inclusive=False)) == {i for i, v in numbers.items() if -1 < v < 2}
    assert ids(docs, q.range_clause(n, "*", "0x00000000")) == {i for i, v in numbers.items() if v <= 0}
    assert ids(docs, q.range_clause(n, "Ix2", "NULL")) == {i for i, v in numbers.items() if v >= 2}
    assert ids(docs, q.range_clause(RAW, "b", "c")) == {0, 1, 6, 7}
    assert ids(docs, q.range_clause(RAW, "blue rod", None, inclusive=False)) == {2, 8}
    assert ids(docs, q.range_clause(RAW, None, None)) == set(range(len(NAMES))) - {4}
    for low, high in (("Ix1", "blue"), ("Ix1", "Lx2"), ("Zx1", "Zx2")):
        with pytest.raises(ValueError):
            q.range_clause(n, low, high)


def test_open_exclusive_ends_are_the_type_limits(spark):
    rows = spark.createDataFrame([(-(2**31),), (0,), (2**31 - 1,)], "n int")
    clause = q.range_clause(q.SearchField("n"), None, "Ix5", inclusive=False)
    assert [r.n for r in rows.filter(clause).collect()] == [0]


def test_filters_reach_the_scan(spark, plan):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    clause = q.must(q.term(q.SearchField("o_orderstatus", "keyword"), "F"), q.between(col("o_totalprice"), 5.0, 9e5))
    text = plan(orders.filter(clause).select("o_orderkey"))
    for pushed in ("EqualTo(o_orderstatus,F)", "GreaterThanOrEqual(o_totalprice,5.0)"):
        assert pushed in text
    assert "o_custkey" not in text.split("ReadSchema")[1]
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert "StringStartsWith(p_name,new)" in plan(parts.filter(q.wildcard(q.SearchField("p_name"), "new*")))


# --- ranking ---------------------------------------------------------------------------------


def test_tfidf(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abxyz") for _ in range(rng.randrange(15))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    postings = p.text_postings(docs, col("id"), "text", col("text"), "simple", offsets=False)
    terms = ["x", "y", "absent"]
    tfs = {i: [t.split().count(w) for w in terms] for i, t in enumerate(texts)}
    dfs = [sum(1 for tf in tfs.values() if tf[k]) for k in range(3)]
    idfs = [1 + math.log(len(texts) / (df + 1)) for df in dfs]
    wanted = {
        i: sum(math.sqrt(n) * idfs[k] ** 2 for k, n in enumerate(tf)) * sum(map(bool, tf)) / 3
        for i, tf in tfs.items()
        if any(tf)
    }
    found = {int(r.doc_id): r.score for r in ranking.tfidf_scores(postings, docs, terms).collect()}
    assert found.keys() == wanted.keys()
    assert all(math.isclose(found[i], wanted[i], rel_tol=1e-9) for i in wanted)


def test_scored_clauses(spark):
    rows = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, False)], "id int, a boolean, b boolean")
    a, b = ranking.constant(col("a"), 2.0), ranking.constant(col("b"))
    either, both = ranking.any_of(a, b), ranking.all_of(a, b)
    assert {r.id: r.s for r in rows.filter(either.matches).select("id", either.score.alias("s")).collect()} == {1: 3.0, 2: 1.0}
    assert {r.id: r.s for r in rows.filter(both.matches).select("id", both.score.alias("s")).collect()} == {1: 3.0}


def test_sorts(spark):
    rows = spark.createDataFrame([(1, "10"), (2, "9"), (3, None), (4, "-1")], "id int, v string")
    for sort in (Sort.BYTE, Sort.SHORT, Sort.INT, Sort.LONG, Sort.FLOAT, Sort.DOUBLE):
        order = ranking.sort_order(col("v"), sort)
        assert [r.id for r in rows.orderBy(*order).collect()] == [4, 3, 2, 1], sort
    for sort in (Sort.STRING, Sort.STRING_VAL):
        assert [r.id for r in rows.orderBy(*ranking.sort_order(col("v"), sort)).collect()] == [3, 4, 1, 2]
    assert ranking.sort_order(col("v"), Sort.NONE) == []
    custom = ranking.sort_order(F.length("v"), Sort.CUSTOM, descending=True)
    assert {r.id for r in rows.orderBy(*custom).limit(2).collect()} == {1, 4}
    lists = spark.createDataFrame([(1, [5, 9]), (2, [7, 2])], "id int, v array<int>")
    assert lists.orderBy(*ranking.sort_order(ranking.least_value(col("v")), Sort.INT)).first().id == 2
    assert ranking.sort_custom(rows, F.length("v").asc_nulls_last(), col("id")).first().id == 2


def test_pages_join_up(spark):
    rows = spark.range(200).select(col("id").alias("doc_id"), (col("id") * 7919 % 13).alias("k"))
    order = [col("k")]
    first, second, both = (ranking.page(rows, order, s, n).collect() for s, n in ((0, 30), (30, 30), (0, 60)))
    assert first + second == both


def test_search(docs):
    both = ranking.any_of(ranking.constant(q.prefix(NAME, "blue")), ranking.constant(q.wildcard(NAME, "*ring")))
    found = ranking.search(docs, both, size=2, tie="id")
    assert [(r.id, r.score) for r in found.top.collect()] == [(1, 2.0), (0, 0.5)] and found.total.first().total_hits == 3
    rest = ranking.search(docs, both, size=5, start=2, tie="id")
    assert [r.id for r in rest.top.collect()] == [2]
    by_name = ranking.search(docs, both, size=9, order=[col("name").desc()], only=col("id") > 0, tie="id")
    assert [r.id for r in by_name.top.collect()] == [2, 1] and by_name.total.first().total_hits == 2


def test_top_k_plan(spark, plan):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = plan(ranking.top_sorted(orders, ranking.sort_order(col("o_totalprice"), Sort.DOUBLE), 50, tie="o_orderkey"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "TakeOrderedAndProject" in plan(ranking.page(orders, [col("o_totalprice")], 100, 50, tie="o_orderkey"))
    assert "TakeOrderedAndProject" in plan(paging.keyset_page(orders, "o_orderkey", after=5))


def test_numbering_with_a_hot_group(spark):
    rows = spark.range(3000).select(
        col("id"), F.when(col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), col("id") % 7)).alias("g")
    )
    numbered = ranking.number_rows(rows.withColumn("mirror", -col("id")), ["mirror"], "n", group=["g"]).collect()
    by_group = {}
    for r in sorted(numbered, key=lambda r: -r.id):
        by_group.setdefault(r.g, []).append(r.n)
    assert len(numbered) == 3000 and all(v == list(range(1, len(v) + 1)) for v in by_group.values())


def test_running_total(spark):
    rows = spark.range(1, 501).select("id", (col("id") % 5).alias("v"))
    found = {r.id: r.t for r in ranking.running_total(rows, ["id"], col("v"), "t").collect()}
    total = 0
    for i in range(1, 501):
        total += i % 5
        assert found[i] == total


def test_keyset_pages_and_batches_agree(spark):
    rows = spark.range(2500).select(F.concat(F.lit("k"), F.lpad(col("id") * 17, 8, "0")).alias("k"))
    pages, after = {}, None
    for number in range(10):
        page = [r.k for r in paging.keyset_page(rows, "k", after).collect()]
        if not page:
            break
        pages.update(dict.fromkeys(page, number))
        after = page[-1]
    assert {r.k: r.page for r in paging.keyset_batches(rows, "k").collect()} == pages


def test_rarity_from_a_dictionary(spark):
    """As counted in the documents; a term that is in none has frequency 0, and equal terms of other fields do not count."""
    docs = spark.createDataFrame([("1", "a", "b"), ("2", "a", "a"), ("3", "b", "a")], "doc_id string, x string, y string")
    dictionary = spark.createDataFrame([("x", "a", 2, 2), ("x", "b", 1, 1), ("y", "a", 2, 2), ("y", "b", 1, 1)], "field string, term string, doc_freq long, total_freq long")
    counted = ranking.with_term_idfs(docs, {"p": F.col("x") == "a", "q": F.col("y") == "b", "r": F.col("x") == "z"}).select("p", "q", "r").first()
    looked_up = docs.select(ranking.dictionary_idfs(dictionary, docs, {"p": ("x", "a"), "q": ("y", "b"), "r": ("x", "z")}).alias("i")).first()["i"]
    assert looked_up == counted


def test_numbers_with_a_given_count_of_ranges(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(50)], "g long, i long")
    found = ranking.number_rows(rows, ["i"], "n", group=["g"], partitions=7).collect()
    assert all(r.n == r.i // 3 + 1 for r in found) and len(found) == 50
    totals = ranking.running_total(rows, ["i"], F.lit(1), "n", partitions=3).collect()
    assert all(r.n == r.i + 1 for r in totals) and len(totals) == 50
