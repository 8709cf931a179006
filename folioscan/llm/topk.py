"""Exact top-k search by inner product, a columnar branch-and-bound over tiles of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import written

TILE = "tile long, n int, dims int, kind string, ids binary, vals binary"
# Queries whose first step over a tile is one product.
TOGETHER = 64
FOUND = "q_tile long, q_pos int, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, scale: float) -> DataFrame:
    """(id, v, is_query) of the rows that take part, components as ``floor(scale * x)``.

    Rows whose id or vector is null, or that hold a null or non-finite component, take no part.
    """
    parts = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("x"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return parts.filter("id is not null and x is not null").filter(~bad).select(
        "id", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"), "is_query"
    )


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """All vectors of a tile as one row, dimension by dimension; short vectors are continued by zeros."""
    dims = max(len(v) for v in rows["v"])
    block = np.zeros((dims, len(rows)), dtype=np.int64)
    for i, v in enumerate(rows["v"]):
        block[: len(v), i] = v
    # -2**63 has no absolute value in int64.
    most = max(int(block.max()), -int(block.min())) if block.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    ids = rows["id"].to_numpy(np.int64)
    return pd.DataFrame(
        {"tile": [rows["tile"].iloc[0]], "n": [len(rows)], "dims": [dims], "kind": [kind], "ids": [ids.tobytes()], "vals": [block.astype(kind).tobytes()]}
    )


def tiles(rows: DataFrame, count: int) -> DataFrame:
    """Rows dealt evenly over ``count`` tiles by their place, whatever their ids or values are."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count))
    return rows.select(place.alias("tile"), "id", "v").groupBy("tile").applyInPandas(_pack, TILE)


def _tails(block: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Length of what each vector has from every cut on."""
    squares = block * block
    return [np.sqrt(squares[cut:].sum(axis=0)) for cut in cuts]


def tile_search(q_ids, q, c_ids, c, k: int, step: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(query position, query id, candidate id, score) of the k best candidates of a tile per query.

    ``q`` and ``c`` hold one row per dimension. Scores grow by ``step`` dimensions at a time; after each
    step only candidates remain whose score so far, plus the product of both remaining lengths, can still
    reach the floor: the k-th of the scores known in full, or that of ``floors`` (k-th scores of other tiles, by
    query) where it is higher. Candidates below a given floor are left out.
    """
    dims = max(len(q), len(c))
    q = np.pad(q, ((0, dims - len(q)), (0, 0)))
    c = np.pad(c, ((0, dims - len(c)), (0, 0)))
    q_most, c_most = (max(int(x.max()), -int(x.min())) if x.size else 0 for x in (q, c))
    most = q_most * c_most * max(dims, 1)
    if most >= 1 << 52:  # past what doubles hold exactly: whole products of Python integers, without bounds
        limit = 1 << 63
        q, c = q.astype(object), c.astype(object)
        for i, own in enumerate(q_ids):
            scores = [max(-limit, min(limit - 1, int(s))) for s in q[:, i] @ c] if dims else [0] * len(c_ids)
            order = sorted((-s, int(j)) for s, j in zip(scores, c_ids, strict=True) if j != own)[:k]
            yield from ((i, int(own), j, -s) for s, j in order)
        return
    q, c = q.astype(np.float64), c.astype(np.float64)
    cuts = list(range(0, dims, step))[1:]
    q_tails, c_tails = _tails(q, cuts), _tails(c, cuts)
    slack = 1.0 + most * 1e-9
    for i, own in enumerate(q_ids):
        if i % TOGETHER == 0:
            first = q[:step, i : i + TOGETHER].T @ c[:step]
        alive = np.flatnonzero(c_ids != own)
        scores = first[i % TOGETHER, alive]
        given = floor = -math.inf if floors is None else float(floors[i])
        for cut, q_tail, c_tail in zip(cuts, q_tails, c_tails, strict=True):
            upper = scores + q_tail[i] * c_tail[alive]
            keep = upper >= floor - slack
            alive, scores, upper = alive[keep], scores[keep], upper[keep]
            if cut == step and len(alive) > k:  # whole scores of the most promising give a floor of this tile
                best = alive[np.argpartition(upper, -k)[-k:]]
                floor = max(floor, (q[:, i] @ c[:, best]).min())
                keep = upper >= floor - slack
                alive, scores = alive[keep], scores[keep]
            if not len(alive):
                break
            scores = scores + q[cut : cut + step, i] @ c[cut : cut + step, alive]
        if given > -math.inf:
            keep = scores >= given
            alive, scores = alive[keep], scores[keep]
        order = np.lexsort((c_ids[alive], -scores))[:k]
        for j, s in zip(c_ids[alive[order]], scores[order], strict=True):
            yield i, int(own), int(j), int(s)


def _matrix(kind: str, dims: int, n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(dims, n)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    rows_per_tile: int = 16_384,
    queries_per_tile: int = 2048,
    step: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row.

    Scores are inner products of the components ``floor(scale * x)``; ties go to the smaller id. A query
    with fewer than k partners gets them all. Rows of the query's own id are its own and never partners.
    Repeated rows are partners of their own, and a repeated query row is answered as often as it stands.
    Null ids or vectors, and vectors with null or non-finite components, take no part. Components and scores
    beyond a long stay at its ends. An empty table has no rows to return.

    Both sides are dealt into tiles of bounded size; only the queries, packed, are copied to every tile.
    The queries of a tile meet each other first, as each is a candidate of the others, and the k-th score found
    there is the floor that a query starts with in every tile of candidates.
    """
    rows = written(quantised(vectors, id_col, vector_col, is_query, scale), "topk")
    n = rows.agg(F.count("*"), F.count_if("is_query")).first()
    n_tiles, q_tiles = (max(1, -(-int(x) // size)) for x, size in zip(n, (rows_per_tile, queries_per_tile), strict=True))
    candidates = tiles(rows, n_tiles)
    every = F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))

    def hits_of(q_ids: np.ndarray, q: np.ndarray, row, floors: np.ndarray | None = None) -> pd.DataFrame:
        hits = tile_search(q_ids, q, np.frombuffer(row.ids, np.int64), _matrix(row.kind, row.dims, row.n, row.vals), k, step, floors)
        return pd.DataFrame(list(hits), columns=["q_pos", "query_id", "vec_id", "score"])

    def with_floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = hits_of(np.frombuffer(row.ids, np.int64), _matrix(row.kind, row.dims, row.n, row.vals), row)
                kth = found.groupby("q_pos")["score"].agg(["size", "min"])
                kth = kth[kth["size"] >= k]
                floors = np.full(row.n, -math.inf)
                floors[kth.index.to_numpy(np.int64)] = kth["min"].to_numpy(np.float64)
                yield pd.DataFrame([(*row, floors.tobytes())], columns=[*batch.columns, "floors"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                q = _matrix(row.q_kind, row.q_dims, row.q_n, row.q_vals)
                out = hits_of(np.frombuffer(row.q_ids, np.int64), q, row, np.frombuffer(row.q_floors, np.float64))
                out.insert(0, "q_tile", row.q_tile)
                yield out

    # Written once: a floor belongs to a place in a tile, and rows may come in another order when a tile is made again.
    queries = written(tiles(rows.filter("is_query"), q_tiles).mapInPandas(with_floors, f"{TILE}, floors binary"), "topk-queries")
    queries = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns])
    found = queries.withColumn("tile", F.explode(every)).join(candidates, "tile").mapInPandas(search, FOUND)
    best = Window.partitionBy("q_tile", "q_pos").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
