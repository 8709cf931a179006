"""Whitening of embeddings by the covariance of their distinct whole-number vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.joins import join_to_one
from folioscan.session import written

# Components whose variance is a smaller share than this of the greatest one are rounding noise.
LEAST_SHARE = 1e-11
LONG = 1 << 63
SCHEMA = "{id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vector: Column, scale: float, shift: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def is_finite(vector: Column) -> Column:
    """Whether a vector is there, is not empty, and holds neither nulls nor values that are not finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


@dataclass(frozen=True)
class Centre:
    """The mean of whole-number vectors as (whole part, remainder over n), so that nothing is rounded before it is subtracted."""

    n: int
    whole: list[int]
    rest: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.whole, np.int64)) - np.array(self.rest, float) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums over the dimensions of (n * x - S)^2 in whole numbers; they must fit a long."""
        near = self.centred(x) * self.n
        if (near**2).sum(axis=1).max(initial=0.0) < 0.99 * LONG and np.abs(x - np.array(self.whole, np.int64)).max(initial=0) * self.n < LONG:
            scaled = (x - np.array(self.whole, np.int64)) * self.n - np.array(self.rest, np.int64)
            return (scaled**2).sum(axis=1)
        exact = [sum(((a - b) * self.n - c) ** 2 for a, b, c in zip(row, self.whole, self.rest, strict=True)) for row in x.tolist()]
        if max(exact) >= LONG:
            raise OverflowError("a deviation does not fit a long")
        return np.array(exact, np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame, column: str, width: int, kind: str) -> list:
    """Weighted sums by dimension: one vector a task, added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = 0
        for batch in batches:
            x, w = _matrix(batch.column(column), width), batch.column("weight").to_numpy()
            sums = sums + (x.T @ w if kind == "double" else (x * w[:, None]).sum(axis=0))
        if not isinstance(sums, int):
            yield pa.RecordBatch.from_pydict({"dim": np.arange(width, dtype=np.int32), "sum": sums})

    found = rows.select(column, "weight").mapInArrow(partial, f"dim int, sum {'double' if kind == 'double' else 'long'}")
    total = F.sum("sum") if kind == "double" else F.sum(F.col("sum").cast("decimal(38,0)"))
    return [r[1] for r in found.groupBy("dim").agg(total).orderBy("dim").collect()]


def _products(rows: DataFrame, column: str, width: int, centred) -> np.ndarray:
    """Weighted products of centred vectors, summed: one upper triangle a task, added up by Spark."""
    i, j = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width))
        some = False
        for batch in batches:
            z, some = centred(_matrix(batch.column(column), width)), True
            sums += (z * batch.column("weight").to_numpy()[:, None]).T @ z
        if some:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(i), dtype=np.int32), "sum": sums[i, j]})

    found = rows.select(column, "weight").mapInArrow(partial, "cell int, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).toPandas()
    out = np.zeros((width, width))
    out[i[found["cell"]], j[found["cell"]]] = found["sum"]
    return out + np.triu(out, 1).T


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000, weights: str = "one"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Entries become whole numbers x = floor(scale * c) + shift. Equal x vectors are grouped, and the fit counts each of them
    once (``weights="one"``) or as often as it stands in the table (``"counts"``); n is the sum of these weights. The
    covariance is a weighted product of centred vectors with divisor n, summed by task and then by Spark; what reaches the
    driver is one matrix of the vectors' width. Components are its unit eigenvectors by falling eigenvalue, the largest entry
    of each positive. Each distinct vector is whitened once, and its row of values is joined back to all rows that have it, those of
    a very frequent vector by broadcast. ``identity_error`` is measured on what was whitened.

    Rows without a vector, with an empty one, or with null or non-finite entries take no part; a null id stays null and
    repeated rows and ids keep a row each. Components without variance (under ``LEAST_SHARE`` of the greatest) do not appear,
    so a table of one distinct vector, like an empty one, gives no rows. Vectors of different lengths are a ``ValueError``; an
    exact deviation that does not fit a long, or an entry whose whole number does not, fails the job.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights are 'one' or 'counts'")
    vector = F.col(vector_col)
    x = whole_numbers(vector, scale, shift)
    keyed = vectors.filter(is_finite(vector)).select(F.col(id_col).alias("id"), x.alias("x"))
    keyed = keyed.select("*", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"))
    # Copies of a vector leave a task as one row.
    rows = F.count("*").alias("rows")
    weight = (F.lit(1.0) if weights == "one" else F.col("rows").cast("double")).alias("weight")
    distinct = written(keyed.groupBy("k1", "k2", "x").agg(rows).select("*", weight), "whitening-vectors")
    widths = [r[0] for r in distinct.select(F.size("x")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {widths}")
    schema = SCHEMA.format(id=f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}")
    if not widths:
        return vectors.sparkSession.createDataFrame([], schema)
    width = widths[0]
    n = int(distinct.agg(F.sum("weight")).first()[0])
    sums = [int(s) for s in _sums(distinct.withColumn("weight", F.col("weight").cast("long")), "x", width, "long")]
    centre = Centre(n, [s // n for s in sums], [s % n for s in sums])
    covariance = _products(distinct, "x", width, centre.centred) / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    kept = int(min(components, (values > LEAST_SHARE * max(values[0], 0.0)).sum()))
    if values[0] <= 0 or not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(width)]
    to_white = (directions * np.sign(largest))[:, :kept] / np.sqrt(values[:kept])
    explained = (values[:kept] / np.trace(covariance)).tolist()

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column("x"), width)
            values = pa.array((centre.centred(found) @ to_white).reshape(-1))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * kept)
            columns = [batch.column(c) for c in ("k1", "k2", "rows", "weight")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(centre.deviations(found)), pa.ListArray.from_arrays(ends, values)], ["k1", "k2", "rows", "weight", "deviation", "white"])

    made = written(distinct.mapInArrow(whitened, "k1 long, k2 long, rows long, weight double, deviation long, white array<double>"), "whitening-white")
    means = np.array(_sums(made, "white", kept, "double")) / n
    error = float(np.abs(_products(made, "white", kept, lambda z: z - means) / n - np.eye(kept)).max())
    joined = join_to_one(keyed.select("id", "k1", "k2"), made.drop("weight"), ["k1", "k2"], "rows")
    return joined.select("id", "deviation", F.posexplode("white").alias("place", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
