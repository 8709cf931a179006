"""Compaction that prunes by several columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_rank(value: Column, cuts: list[float]) -> Column:
    """How many of some ascending cut points a value reaches; 0 for null."""
    return F.coalesce(reduce(lambda a, b: a + b, [(value >= F.lit(c)).cast("bigint") for c in cuts], F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def interleaved(ranks: list[Column], bits: int) -> Column:
    """One number of the bits of several, the highest bits of all first: close numbers are close in each of them."""
    places = [F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), bit * len(ranks) + i) for i, rank in enumerate(ranks) for bit in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), places)


def zorder_compacted(df: DataFrame, columns: list[str], bits: int = 6, error: float = 0.002, partitions: int | None = None) -> DataFrame:
    """The same rows, laid out so that a filter on any of some number columns leaves out row groups; write it to compact.

    A column's values are ranked among 2^``bits`` quantiles, found approximately over the whole table in one pass, so skewed
    columns are cut evenly. Rows are range-partitioned and sorted by the interleaved bits of the ranks. Equal ranks
    are told apart by the values, so no range is a single rank however often a value stands.
    """
    if not columns or not 1 <= bits <= 62 // len(columns):
        raise ValueError("give columns, and no more than 62 bits in all")
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.approxQuantile(columns, shares, error)
    place = interleaved([quantile_rank(F.col(c), sorted(set(cuts))) for c, cuts in zip(columns, found, strict=True)], bits)
    keyed = df.withColumn("_z", place)
    keys = ["_z", *columns]
    ranged = keyed.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    return ranged.drop("_z")
