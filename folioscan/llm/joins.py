"""A join of many rows with one row per key, where a key may hold a great share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot with more rows than this, and with more than one row in HOT_KEYS: so there are fewer hot keys than that.
HOT_ROWS = 100_000
HOT_KEYS = 10_000


def join_to_one(rows: DataFrame, one: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``one`` on ``keys``; ``one`` has a row per key, with the number of its rows in ``count``.

    Rows of hot keys stay where they are and meet a broadcast of fewer than ``HOT_KEYS`` rows of ``one``; the others are
    shuffled, at most as many of a key as make it hot. Both tables are read twice if there are hot keys, so they should be
    written ones.
    """
    total, most = one.agg(F.sum(count), F.max(count)).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return rows.join(one.drop(count), keys)
    is_hot = F.col(count) > bound
    hot = one.filter(is_hot)
    warm = rows.join(F.broadcast(hot.drop(count)), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.filter(~is_hot).drop(count), keys)
    return warm.unionByName(rest)
