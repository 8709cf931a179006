import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioscan.llm import joins, trie
from folioscan.llm.queries import QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, depth string, size string"


def slow_trie(sequences):
    """conv -> list of (role, text), as the contract says, node by node."""
    members = defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(out[k][5] for k in kids[p]) if kids[p] else 1
        saved = sum(out[k][6] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = [c for c in members[p] if len(sequences[c]) == len(p)]
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[p] = (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves, saved, digest)
    return sorted(map(repr, out.values()))


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role, text))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query_against_node_by_node(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01")) == slow_trie(rebuilt(rows))


@pytest.mark.parametrize(("per_task", "hot_rows"), [(50_000, 100_000), (8, 100_000), (40, 3)])
def test_odd_conversations(spark, table, monkeypatch, per_task, hot_rows):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["u", "a"]), rng.choice(["x", "yé", "z " * 50])) for c in range(60) for t in range(rng.randint(1, 4))]
    rows += [(101, t, "u", f"t{t % 7}") for t in range(300)] + [(106, t, "u", f"t{t % 7}") for t in range(250)]
    rows += [(200, None, None, None), (200, 1, "u", ""), (None, 1, "u", "x"), (-7, 2, "u", "x"), (-7, 1, "u", None), (-5, 1, "a", "x"), (1 << 60, 1, "u", "x")]
    turns = table([(*r, "k", "k") for r in rows], SCHEMA)
    found = trie.prefix_trie(*trie.with_shared_heads(trie.ordered_turns(turns)), per_task=per_task)
    assert of(found) == slow_trie(rebuilt(rows))


def test_repeated_rows_and_empty_tables(spark, table):
    rows = [(1, 1, "u", "x")] * 3 + [(1, 2, "u", "y")] + [(2, 1, "u", "x")]
    found = trie.prefix_trie(*trie.with_shared_heads(trie.ordered_turns(table([(*r, "k", "k") for r in rows], SCHEMA))))
    assert of(found) == slow_trie(rebuilt(rows))
    assert trie.prefix_trie(*trie.with_shared_heads(trie.ordered_turns(table([], SCHEMA)))).collect() == []


def test_sums_over_random_forests():
    rng = np.random.default_rng(1)
    for kind in ("random", "path", "star"):
        n = 400
        parent = np.array([-1 if i % 97 == 0 else {"random": rng.integers(max(0, i - 5), i), "path": i - 1, "star": i - i % 97}[kind] for i in range(n)])
        depth = np.zeros(n, int)
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        values = rng.integers(0, 100, (n, 2))
        weight, expected = rng.integers(1, 4, n), values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                expected[parent[i]] += expected[i]
        order = rng.permutation(n)
        place = np.empty(n, int)
        place[order] = np.arange(n)
        moved = np.where(parent[order] < 0, -1, place[parent[order]])
        assert (trie.subtree_sums(weight[order], depth[order], moved, values[order]) == expected[order]).all()
