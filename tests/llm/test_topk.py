import numpy as np
from pyspark.sql import functions as F

from folioscan.llm.topk import tile_search, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, tile string, id long"


def brute(rows, k=5, scale=256):
    use = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows]
    out = []
    for i, v in use:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in use if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(table, rows, **kw):
    data = [(i, v, "x", "y", 7) for i, v in rows]
    found = top_k(table(data, SCHEMA), F.col("vec_id") % 50 == 0, **kw)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def test_against_brute_force_over_many_tiles(table):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=24) * 0.3]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    assert run(table, rows, rows_per_tile=50, queries_per_tile=3, step=5) == brute(rows)


def test_nulls_odd_numbers_and_few_partners(table):
    good = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0])]
    bad = [(None, [1.0, 1.0]), (3, None), (50, [1.0, None]), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0])]
    assert run(table, good + bad) == brute(good)
    assert run(table, []) == []
    assert run(table, [(0, [1.0])]) == []
    assert run(table, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_repeated_queries_are_answered_as_often(table):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]
    assert run(table, rows) == sorted([(0, 1, 1, 131072), (0, 2, 1, 131072)] * 2)


def test_floors_of_other_tiles_leave_out_what_cannot_be_among_the_best():
    rng = np.random.default_rng(5)
    q, c = (np.floor(rng.normal(size=(40, n)) * 80).astype(np.int64) for n in (70, 3000))
    q_ids, c_ids = np.arange(70) + 10_000, np.arange(3000)
    whole = {(i, j, s) for i, _, j, s in tile_search(q_ids, q, c_ids, c, 5, 8)}
    floors = np.array([sorted((s for i, _, s in whole if i == n), reverse=True)[2] for n in range(70)], float)
    kept = {(i, j, s) for i, _, j, s in tile_search(q_ids, q, c_ids, c, 5, 8, floors)}
    assert kept == {(i, j, s) for i, j, s in whole if s >= floors[i]} and len(kept) < len(whole)
    assert not list(tile_search(q_ids, q, c_ids, c, 5, 8, floors * 0 + 1e9))
    assert {(i, j, s) for i, _, j, s in tile_search(q_ids, q, c_ids, c, 5, 8, floors * 0 - np.inf)} == whole


def test_a_tie_with_a_floor_stays(table):
    rows = [(i, [1.0, 0.0]) for i in range(0, 600, 10)] + [(i, [1.0, 0.0]) for i in range(1, 40, 2)]
    assert run(table, rows, rows_per_tile=7, queries_per_tile=50, step=1) == brute(rows)


def test_large_components_stay_exact():
    big = np.array([[1 << 40], [3]], dtype=np.int64)
    rows = np.array([[1 << 22, (1 << 22) + 1], [5, 4]], dtype=np.int64)
    hits = list(tile_search(np.array([9]), big, np.array([1, 2]), rows, 2, 1))
    assert hits == [(0, 9, 2, ((1 << 22) + 1) * (1 << 40) + 12), (0, 9, 1, (1 << 62) + 15)]
