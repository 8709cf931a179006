import random

import numpy as np
import pytest

from folioscan.llm import joins, ngram_join
from folioscan.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n string, node string, token string"


def grams(text, words=3):
    for low, high in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True):
        text = (text or "").replace(low, high)
    for space in "\x09\x0a\x0b\x0c\x0d":
        text = text.replace(space, " ")
    found = [w for w in text.split(" ") if w]
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def slow_groups(rows, words=3, at_least=90):
    """(id, size, least id of the component) of every row."""
    sets = [grams(t, words) for _, t in rows]
    least = list(range(len(rows)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= at_least * len(a | sets[j]):
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return sorted(repr((d, len(s), names.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def near_copies(rng, vocabulary, size, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = rng.choice(vocabulary)
        yield " ".join(words)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert of(QUERIES["op11_ngram_join"](spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id")) == slow_groups(rows)


@pytest.mark.parametrize("settings", [{}, {"SMALL": 3, "PER_TILE": 5}, {"SKETCH_BITS": 2, "SMALL": 2, "PER_TILE": 3, "HELD": 100}])
def test_dense_groups_and_odd_rows(spark, table, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    if settings:
        monkeypatch.setattr(joins, "HOT_ROWS", 3)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [t for size in (30, 60, 90) for t in near_copies(rng, words, size, 25, 2)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += ["one line of all that is said here " * k for k in (1, 2, 3, 50)] + ["a b", "A  b", "a\tB\n", "a", "x y z", "X y Z"]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \n"), (None, "x y z"), (None, "p q r s"), (3, texts[40]), (3, texts[40]), (None, None)]
    rng.shuffle(rows)
    docs = table([(*r, "a", "b", "c") for r in rows], SCHEMA)
    words, at_least = (2, 70) if settings.get("SMALL") == 3 else (3, 90)
    assert of(ngram_join.linked_documents(docs, words=words, at_least=at_least)) == slow_groups(rows, words, at_least)


def test_empty_tables_and_limits(table):
    assert ngram_join.linked_documents(table([], SCHEMA)).collect() == []
    assert of(ngram_join.linked_documents(table([(1, "", "a", "b", "c")], SCHEMA))) == [repr((1, 0, 1))]
    with pytest.raises(ValueError, match="limit"):
        ngram_join.linked_documents(table([], SCHEMA), at_least=0)


def test_hashes_and_order():
    a, b = ngram_join.ngram_hashes("a b c d", 3), ngram_join.ngram_hashes("A\tB  c\nd", 3)
    assert (a == b).all() and len(a) == 2 and len(ngram_join.ngram_hashes("w " * 300_000, 3)) == 1
    assert len({int(ngram_join.ngram_hashes(t, 3)[0]) for t in ("a", "a a", "a a a", "b", "b a", "a b")}) == 6
    assert not len(ngram_join.ngram_hashes(None, 3)) and ngram_join.set_key(a) == ngram_join.set_key(b)
    counts = np.random.default_rng(1).integers(0, 9, 1 << ngram_join.SKETCH_BITS)
    order = ngram_join.Order.of(counts, 8)
    mass = np.bincount(order.fragment, counts, minlength=8)
    assert mass.max() < 1.01 * mass.min() and (np.diff(order.fragment[np.argsort(order.place)]) >= 0).all()


def test_odd_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for size, changed in ((3, 1), (300, 20), (5000, 0), (5000, 700), (4000, 4000)):
        a, b = base[:size], np.r_[base[: size - changed], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]
        x, y = ngram_join.odd_bits(a), ngram_join.odd_bits(b[: len(b) // 2 + 1])
        assert len(x) * 8 >= max(128, size // 2) and (ngram_join.fold(x, 16) == ngram_join.odd_bits(a, 128)).all()
        size = min(len(x), len(y))
        differ = np.bitwise_count(ngram_join.fold(x, size) ^ ngram_join.fold(y, size)).sum()
        assert differ <= len(np.setxor1d(a, b[: len(b) // 2 + 1]))


def test_ids_that_may_be_wanted(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i) if i else None, "x") for i in range(500)], "id string, text string")
    wanted = spark.createDataFrame([(None,), ("7",), ("499",)], "id string")
    found = {r.id for r in ngram_join.id_filter(docs, wanted).collect()}
    assert found >= {None, "7", "499"} and len(found) < 10
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)
    assert {r.id for r in ngram_join.id_filter(docs, wanted).collect()} >= {None, "7", "499"}
