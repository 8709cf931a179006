import random

import xxhash

from folioscan.llm.components import components
from folioscan.llm.queries import QUERIES
from folioscan.llm.simhash import links_within, near_duplicates, one_of_each, simhash

SCHEMA = "doc_id long, text string, fp string, component string, root long"


def slow_hash(text, words=3):
    """Bit by bit, as the contract says."""
    for low, high in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True):
        text = text.replace(low, high)
    for space in "\x09\x0a\x0b\x0c\x0d":
        text = text.replace(space, " ")
    found = [w for w in text.split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] if len(found) >= words else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Least node that each reaches."""
    least = dict(zip(nodes, nodes, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def near(a, b, radius=3):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= radius


def test_fingerprints():
    texts = ["", " \t", "One", "one two", "A b C d", "a\u00a0b c\x1cd e f", "É é x " * 9, "w " * 300 + "z"]
    for text in texts:
        assert simhash(text, 3) % (1 << 64) == slow_hash(text)
    assert simhash(None, 3) == 0


def test_links_against_all_pairs(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:120]:
        for _ in range(4):
            q = p
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                q ^= 1 << bit
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if near(a, b)]
    expected = groups(signed, pairs)
    for per_tile in (2048, 7):
        links = [(r.a, r.b) for r in links_within(frame, per_tile=per_tile).collect()]
        assert all(near(a, b, 3 * len(signed)) for a, b in links) and groups(signed, links) == expected


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 2000 + i) for i in range(300)] + [(7, 7), (3, 2), (2, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(1, 101)} | {2000 + i: 1000 for i in range(300)}


def test_documents_against_brute_force(spark):
    found = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {d.doc_id: slow_hash(d.text) for d in docs}
    expected = groups(sorted(prints), [(a, b) for a in prints for b in prints if a < b and near(prints[a], prints[b])])
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


def test_odd_rows(table):
    rows = [(1, None), (2, ""), (3, " "), (None, None), (5, "a b c d"), (4, "A B c D"), (4, "A B c D"), (None, "q r s"), (9, "q r s t u " * 50_000)]
    docs = table([(i, t, "x", "y", 0) for i, t in rows], SCHEMA)
    found = sorted(((r.doc_id, r.component) for r in near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(1, 1), (2, 1), (3, 1), (None, 1), (5, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=repr)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 9, None], key=repr)
    assert near_duplicates(table([], SCHEMA)).collect() == []


def test_texts_of_repeated_and_null_ids(table):
    a, b, c = "one two three four five six", "zwei drei vier fünf acht neun", "lorem ipsum dolor sit amet elit"
    cases = [
        ([(5, a), (5, b), (6, a), (9, b)], [(5, a), (5, b)]),
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(None, a), (None, a), (None, a), (None, c), (7, c), (None, "")], [(None, a), (7, c), (None, "")]),
        ([(2, a)] * 40 + [(2, b)] * 3 + [(1, b)], [(2, a), (1, b)]),
    ]
    for rows, expected in cases:
        docs = table([(i, t, f"s{n}", "y", n) for n, (i, t) in enumerate(rows)], SCHEMA)
        found = [tuple(r) for r in one_of_each(docs).collect()]
        assert sorted((f[:2] for f in found), key=repr) == sorted(expected, key=repr)
        again = table([(i, t, f"s{n}", "y", n) for n, (i, t) in reversed(list(enumerate(rows)))], SCHEMA)
        assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in one_of_each(again).collect())
