"""Paging a table by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.ranking import number_rows

# Fixed value: rows per page of the source query.
PAGE_ROWS = 1_000


def keyset_page(df: DataFrame, key: str, after=None, rows: int = PAGE_ROWS) -> DataFrame:
    """The page that follows a key; the last key of a page is the next cursor."""
    rest = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(rows)


def keyset_batches(df: DataFrame, key: str, rows: int = PAGE_ROWS) -> DataFrame:
    """Every row with the number (from 0) of the page a walk by a unique key would find it on."""
    numbered = number_rows(df, [key], "_row")
    page = F.floor((F.col("_row") - 1) / rows).cast("bigint")
    return numbered.select(*df.columns, page.alias("page"))
