import math

import numpy as np
import pytest

from folioscan.llm import joins
from folioscan.llm.queries import QUERIES
from folioscan.llm.whitening import Centre, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def slow(rows, most=16):
    """n, exact deviations, eigenvalues and projections of the usable rows, with whole numbers of Python."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        z = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        out.setdefault(i, []).append((deviation, [z @ vectors[:, -1 - k] / math.sqrt(values[-1 - k]) for k in range(min(most, len(values)))]))
    return n, [values[-1 - k] / values.sum() for k in range(min(most, len(values)))], out


def check(found, rows, most=16):
    n, explained, expected = slow(rows, most)
    by_row = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-9 and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        by_row.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
    assert len(found) == sum(len(v) for v in expected.values()) * len(explained)
    for k in range(len(explained)):
        signs = {round(w / e[1][k], 6) for i, es in expected.items() for (d, w), e in zip(sorted(by_row[i, k + 1]), sorted(es), strict=True) if abs(e[1][k]) > 1e-3}
        assert len(signs) == 1 and abs(signs.pop()) == 1
        for i, es in expected.items():
            for (d, w), e in zip(sorted(by_row[i, k + 1]), sorted(es), strict=True):
                assert d == e[0] and math.isclose(abs(w), abs(e[1][k]), rel_tol=1e-7, abs_tol=1e-9)


def test_query_against_whole_numbers(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").collect(), rows)


@pytest.mark.parametrize("hot_rows", [100_000, 2])
def test_odd_and_repeated_rows(spark, table, monkeypatch, hot_rows):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(7, rows[1][1]), (7, rows[1][1]), (None, rows[2][1])]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [math.nan, 0.0, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0, 0.0]), (204, [])]
    docs = table([(i, v, "x", 1) for i, v in rows + odd], SCHEMA)
    check(whiten(docs).collect(), rows, 4)
    assert {r.component for r in whiten(docs, components=2).collect()} == {1, 2}
    counted = whiten(docs, weights="counts").collect()
    assert {r.n for r in counted} == {len(rows)} and max(r.identity_error for r in counted) < 1e-9


def test_tables_without_variance(table):
    assert whiten(table([], SCHEMA)).collect() == [] and whiten(table([(1, None, "x", 1)], SCHEMA)).collect() == []
    same = whiten(table([(i, [1.0, 2.0], "x", 1) for i in range(9)], SCHEMA))
    assert same.collect() == [] and same.columns[0] == "vec_id"
    flat = whiten(table([(i, [float(i), 2.0], "x", 1) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 9
    with pytest.raises(ValueError, match="different lengths"):
        whiten(table([(1, [1.0], "x", 1), (2, [1.0, 2.0], "x", 1)], SCHEMA))
    with pytest.raises(ValueError, match="weights"):
        whiten(table([], SCHEMA), weights="rows")


def test_deviations_are_exact_or_refused():
    centre = Centre(3, [10], [2])
    assert centre.deviations(np.array([[10], [11], [11]])).tolist() == [4, 1, 1]
    wide = Centre(1 << 31, [0], [0])
    assert wide.deviations(np.array([[1]])).tolist() == [1 << 62]
    with pytest.raises(OverflowError):
        wide.deviations(np.array([[2]]))
