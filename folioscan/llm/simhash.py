"""Near-duplicates by SimHash: exact comparison of fingerprints, tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folioscan.llm.components import components
from folioscan.session import written

SEED = 42
BITS = 64
STEP = 1 << 16


def simhash(text: str | None, words: int) -> int:
    """Signed 64-bit SimHash of a text's word shingles; 0 for a text without words.

    Only A-Z are lowered and only ASCII white space parts words, which is what these methods of bytes do.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _simhashes(texts: pd.Series, words: pd.Series) -> pd.Series:
    n = int(words.iloc[0]) if len(words) else 0
    return texts.map(lambda t: simhash(t, n)).astype("int64")


def fingerprint(text: str | Column, words: int = 3) -> Column:
    """SimHash of a text column over word shingles, as a long. Null and wordless texts have fingerprint 0."""
    return _simhashes(text, F.lit(words))


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius in two tiles: one for each fingerprint at most, not all pairs."""
    rows, cols = [], []
    width = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), width):
        i, j = np.nonzero(np.bitwise_count(a[at : at + width, None] ^ b[None, :]) <= radius)
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    values, node = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    i, j = node[: len(i)], node[len(i) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    apart = label != np.arange(len(values))
    return values[apart], values[label[apart]]


def links_within(prints: DataFrame, radius: int = 3, per_tile: int = 2048, fp: str = "fp") -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``radius`` bits of each other.

    Fingerprints that differ in few bits agree in one of radius + 1 bands, so they are dealt by the hash of
    each band, by their number of one bits and, where these are many, by a salt. Tiles of one band hash are
    compared by exclusive-or and bit counts, except those whose bit counts differ by more than the radius.
    Every pair of tiles is a row of its own. A tile pair gives the links of a spanning forest, so a dense group makes no more
    links than it has members in each tile pair.
    """
    bands = radius + 1
    if not 0 <= radius < BITS:
        raise ValueError("the radius must lie between 0 and 63")
    n = prints.count()
    # The more fingerprints, the finer the band hash: about two tiles' worth for each hash and band.
    fold = 1 << max(0, min(BITS // bands, int(math.log2(max(1, n // (2 * per_tile)) or 1))))
    edges = [BITS * i // bands for i in range(bands + 1)]
    parts = [F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < BITS else F.col(fp) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.pmod(F.xxhash64(p, F.lit(i)), F.lit(fold)).alias("key")) for i, p in enumerate(parts)])
    rows = prints.select(F.col(fp).alias("fp"), F.bit_count(fp).cast("int").alias("ones"), F.explode(keys).alias("k")).select("fp", "ones", "k.band", "k.key")
    group = ["band", "key", "ones"]
    salts = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(per_tile)).cast("int").alias("salts"))
    dealt = rows.join(salts, group).withColumn("salt", F.pmod(F.xxhash64("fp", F.lit("salt")), F.col("salts")).cast("int"))
    tiles = written(dealt.groupBy(*group, "salt").agg(F.collect_list("fp").alias("fps")), "tiles")
    offsets = F.explode(F.sequence(F.lit(0), F.lit(radius)))
    left = tiles.select("band", "key", F.col("salt").alias("a_salt"), F.col("fps").alias("a"), F.col("ones").alias("a_ones"), offsets.alias("step"))
    left = left.withColumn("ones", F.col("a_ones") + F.col("step"))
    pairs = left.join(tiles, group).filter("step > 0 or a_salt <= salt")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["fps"], strict=True):
                x, y = _forest(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius)
                if len(x):
                    yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return pairs.select("a", "fps").mapInPandas(compare, "a long, b long")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """Add to distinct fingerprints the ``root`` that linked ones share."""
    roots = components(links_within(distinct.select("fp"), radius), "a", "b")
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): documents whose fingerprints are linked at ``radius`` bits or fewer share a component.

    The component is named by the least id in it. Null and wordless texts have fingerprint 0 and are linked
    like others; equal texts have equal fingerprints. A null id names no component: one whose ids are all null
    has the null component. Repeated rows and ids keep a row each. An empty table gives no rows.

    Copies are brought down to one row per fingerprint before anything is compared.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")), "simhash")
    rooted = _rooted(prints.groupBy("fp").agg(F.min("id").alias("least")), radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_print = written(rooted.join(named, "root").select("fp", "component"), "simhash-components")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One document of every component, all columns kept: the one with the least id, null ids last.

    Rows are told apart by id and text, so the different texts of one id are documents of their own and rows without an
    id are reduced like others. Of rows with the least id of a component the one with the least hash of its text stays,
    and of repeated rows that differ elsewhere the one with the least hash of all columns: the same on each run. Null and
    wordless texts form one component. An empty table gives no rows.
    """
    id_, text = F.col(id_col), F.col(text_col)
    key = [F.xxhash64(id_.isNull(), id_, text).alias("_k1"), F.xxhash64(text, id_, F.lit(1)).alias("_k2")]
    prints = written(docs.select(id_.alias("id"), *key, fingerprint(text, words).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_k1", "_k2")).alias("first")
    named = _rooted(prints.groupBy("fp").agg(first), radius).groupBy("root").agg(F.min("first").alias("first"))
    # Copies leave a task as one row; the texts are shuffled once, as both steps have the same key.
    row = F.struct(*[F.col(c) for c in docs.columns])
    unique = docs.select("*", *key).groupBy("_k1", "_k2").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_row"))
    return unique.join(named.select("first._k1", "first._k2"), ["_k1", "_k2"], "left_semi").select("_row.*")
