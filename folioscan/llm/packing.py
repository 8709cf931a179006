"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import written


class Plan:
    """How many pieces of each length go together.

    ``slots`` maps a length to rows (first rank, pieces per bin, first bin, offset in the bin): the pieces of
    that length, ranked from 0, fill the bins one after the other. ``sizes`` gives (first bin, size, contents)
    for runs of like bins.
    """

    def __init__(self, slots: dict[int, list[tuple[int, int, int, int]]], sizes: list[tuple[int, int, int]], bins: int) -> None:
        self.slots, self.sizes, self.bins = slots, sizes, bins


def best_size(length: int, n: int, sizes: Sequence[int], per_bin: float) -> int:
    """The size to open for n pieces of a length: least cost per token that they bring; larger on ties."""
    fitting = [s for s in sizes if s >= length]
    return min(fitting, key=lambda s: ((s + per_bin) / (min(n, s // length) * length), -s))


def plan(counts: dict[int, int], sizes: Sequence[int], per_bin: float = 0.0) -> Plan:
    """Variable-capacity best fit over a histogram of lengths, longest first.

    Each piece goes to the open bin with the least room that still holds it, of these to the fullest. If none does, a bin of the size
    with the least cost per token opens; ``per_bin`` is the cost of a sequence besides its length. At the end
    every bin is set to the smallest permitted size that holds its contents. Bins with the same contents are
    kept as one group, so the work depends on the number of different lengths only.
    """
    sizes = sorted(set(sizes))
    if any(not 0 < length <= sizes[-1] for length in counts):
        raise ValueError("lengths must lie between 1 and the largest size")
    # A group: number of bins, contents so far, and its pieces as (length, first rank, per bin).
    groups: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    rooms: list[tuple[int, int, int]] = []  # (room, -contents, group): least room first, then the fullest

    def put(room: int, n: int, used: int, pieces: list) -> None:
        if n:
            groups.append((n, used, pieces))
            insort(rooms, (room, -used, len(groups) - 1))

    def shifted(pieces: list, bins: int) -> list:
        return [(length, rank + per * bins, per) for length, rank, per in pieces]

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, (length,))
            if at == len(rooms):
                size = best_size(length, left, sizes, per_bin)
                put(size, max(1, left // (size // length)), 0, [])
                continue
            room, _, g = rooms.pop(at)
            n, used, pieces = groups[g]
            per = room // length
            full, rest = min(n, left // per), 0
            put(room - per * length, full, used + per * length, [*pieces, (length, rank, per)])
            rank, left = rank + full * per, left - full * per
            if full < n and left:
                rest = left
                put(room - rest * length, 1, used + rest * length, [*shifted(pieces, full), (length, rank, rest)])
                rank, left = rank + rest, 0
            put(room, n - full - bool(rest), used, shifted(pieces, full + bool(rest)))
            groups[g] = (0, 0, [])
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    runs, bins = [], 0
    for n, used, pieces in groups:
        if not n or not used:
            continue
        offset = 0
        for length, rank, per in pieces:
            slots.setdefault(length, []).append((rank, per, bins, offset))
            offset += length * per
        runs.append((bins, sizes[bisect_left(sizes, used)], used))
        bins += n
    return Plan({k: sorted(v) for k, v in slots.items()}, runs, bins)


def pieces_of(docs: DataFrame, id_col: str, length_col: str, largest: int) -> DataFrame:
    """(id, piece, start, length): lengths over ``largest`` are cut into pieces of that length and a rest."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("total")).filter("total > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / F.lit(largest)).cast("long")))
    return rows.select("id", "total", piece.alias("piece")).select(
        "id",
        "piece",
        (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * largest).alias("length"),
    )


def ranked_in_length(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, among the pieces of one length.

    Pieces are counted per length and task first and numbered within these small groups, so that a length
    that very many pieces share is not gathered anywhere.
    """
    rows = written(pieces.withColumn("part", F.spark_partition_id()), "packing")
    per_part = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("length", "part").orderBy("id", "piece")
    numbered = rows.withColumn("at", F.row_number().over(inner) - 1)
    return numbered.join(starts, ["length", "part"]).select(
        "id", "piece", "start", "length", (F.col("first") + F.col("at")).alias("rank")
    )


def best_fit_pack(
    docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", sizes: Sequence[int] = (512, 1024, 2048, 4096), per_bin: float = 16.0
) -> DataFrame:
    """(id, piece, start, length, bin_id, bin_size, bin_used, bin_offset): where each piece of each document goes.

    Documents longer than the largest size are cut into pieces of that size and a rest; ``start`` is the first
    token of a piece. Null, zero and negative lengths have no pieces. Repeated ids and rows are documents of
    their own; a null id stays null. Which of several pieces of the same length goes into which bin is not
    defined. An empty table gives no rows.

    Only the histogram of lengths reaches the driver: it has at most as many entries as the largest size.
    """
    pieces = ranked_in_length(pieces_of(docs, id_col, length_col, max(sizes)))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, sizes, per_bin)
    starts = np.array([s[0] for s in made.sizes] or [0])
    size_used = np.array([s[1:] for s in made.sizes] or [(0, 0)])
    shared = docs.sparkSession.sparkContext.broadcast(({k: np.array(v) for k, v in made.slots.items()}, starts, size_used))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, starts, size_used = shared.value
        for batch in batches:
            found = np.zeros((len(batch), 2), np.int64)
            rank = batch["rank"].to_numpy()
            for length, rows in batch.groupby("length").indices.items():
                table = slots[int(length)]
                slot = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                within = rank[rows] - slot[:, 0]
                found[rows, 0] = slot[:, 2] + within // slot[:, 1]
                found[rows, 1] = slot[:, 3] + within % slot[:, 1] * length
            run = np.searchsorted(starts, found[:, 0], side="right") - 1
            yield batch.drop(columns="rank").assign(
                bin_id=found[:, 0], bin_size=size_used[run, 0], bin_used=size_used[run, 1], bin_offset=found[:, 1]
            )

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece long, start long, length long, bin_id long, bin_size long, bin_used long, bin_offset long"
    return pieces.select("id", "piece", "start", "length", "rank").mapInPandas(place, schema).withColumnRenamed("id", id_col)
