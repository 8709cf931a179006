"""Documents linked by the Jaccard similarity of their word n-grams, joined by fragments of one order of all n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import joins
from folioscan.llm.components import components
from folioscan.llm.joins import join_to_one
from folioscan.session import gathered, written

# Counters of the sketch of n-gram counts (2 to this power): 2 MB on the driver and in each task.
SKETCH_BITS = 18
# Groups of an n-gram up to this size are compared as they stream by; larger ones are laid out as tiles.
SMALL = 64
PER_TILE = 2048
CELLS = 1 << 21
HELD = 1 << 20
MEMBER = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("b1", "<u8"), ("b2", "<u8"), ("n", "<i8"), ("pos", "<i8")])
# Bits of the broadcast table that tells which texts are read again: at most a million words, 16 MB.
FILTER_BITS = 1 << 26
PAIR = "a1 long, a2 long, b1 long, b2 long"


def ngram_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word n-grams; with fewer words, of the whole sequence.

    Only A-Z are lowered and only ASCII white space parts words, which is what these methods of bytes do. Words are
    hashed one by one, and an n-gram's hash mixes those of its words in order.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    mixed = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : len(found) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of n-grams."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist())


def odd_bits(hashes: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bytes of bits that tell whether the number of n-grams with that place (the hash modulo the bits) is odd.

    Two sets differ at least in as many n-grams as there are bits that differ. Half as many bits as n-grams, but 128 at least
    and a power of two, tell sets of little in common apart; ``fold`` brings more bits down to fewer.
    """
    bits = bits or max(128, 1 << (max(len(hashes), 1) // 2 - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def fold(odd: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(odd.reshape(-1, size), axis=0)


@dataclass(frozen=True)
class Order:
    """The global order of n-grams: by the count of their counter, rarest first, then by hash.

    ``place`` is a counter's place by count, ``fragment`` the piece of the order it falls into; ``count`` is no less than the
    number of texts that have any n-gram of it.
    """

    count: np.ndarray
    place: np.ndarray
    fragment: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, fragments: int) -> Order:
        by_count = np.argsort(counts, kind="stable")
        place = np.empty(len(counts), np.int64)
        place[by_count] = np.arange(len(counts))
        mass = np.cumsum(counts[by_count])
        cut = np.minimum(mass * fragments // max(1, int(mass[-1]) + 1), fragments - 1)
        fragment = np.empty(len(counts), np.int64)
        fragment[by_count] = cut
        return Order(counts, place, fragment)

    def sort(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes in this order, and the counter of each."""
        counters = (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        order = np.lexsort((hashes, self.place[counters]))
        return hashes[order], counters[order]


@dataclass(frozen=True)
class Limit:
    """Two sets link when ``of`` * intersection >= ``at_least`` * union."""

    at_least: int
    of: int

    def prefix(self, n: int) -> int:
        """Linked sets share one of this many first n-grams, in any order of all n-grams."""
        return n - -(-self.at_least * n // self.of) + 1

    def overlap(self, total: np.ndarray) -> np.ndarray:
        """The least intersection of linked sets whose sizes add up to ``total``."""
        return -(-self.at_least * total // (self.of + self.at_least))

    def possible(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether two different sets that share an n-gram as their first can be linked, a bound on how much they differ).

        By their sizes; by how many n-grams are left from the places of the shared one on; and by the odd bits of their
        n-grams, two sets differing at least in as many n-grams as there are bits that differ.
        """
        need = self.overlap(a["n"] + b["n"])
        differ = np.bitwise_count(a["b1"] ^ b["b1"]).astype(np.int64) + np.bitwise_count(a["b2"] ^ b["b2"])
        left = np.minimum(a["n"] - a["pos"], b["n"] - b["pos"])
        sizes = self.of * np.minimum(a["n"], b["n"]) >= self.at_least * np.maximum(a["n"], b["n"])
        other = (a["k1"] != b["k1"]) | (a["k2"] != b["k2"])
        return other & sizes & (left >= need) & (differ <= a["n"] + b["n"] - 2 * need), differ


def _pair_frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Pairs of members by key, the lesser key first."""
    swap = (b["k1"] < a["k1"]) | ((b["k1"] == a["k1"]) & (b["k2"] < a["k2"]))
    first, second = np.where(swap, b, a), np.where(swap, a, b)
    return pd.DataFrame({"a1": first["k1"], "a2": first["k2"], "b1": second["k1"], "b2": second["k2"]})


def _nearest(i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Marks the pairs (i, j) that differ least for one of the two."""
    near = np.zeros(len(i), bool)
    for side in (i, j):
        order = np.lexsort((differ, side))
        first = np.ones(len(order), bool)
        first[1:] = side[order[1:]] != side[order[:-1]]
        near[order[first]] = True
    return near


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """(id, k1, k2, n, odd) of every text, and beside it a task's counts (counter, count) of the n-grams of its texts."""
    schema = "id string, k1 long, k2 long, n long, odd binary, counter int, count long"

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held, waiting = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def count() -> np.ndarray:
            return np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)

        for batch in batches:
            keys, sizes, odd = [], [], []
            for text in batch["text"]:
                hashes = ngram_hashes(text, words)
                keys.append(set_key(hashes))
                odd.append(odd_bits(hashes).tobytes())
                sizes.append(len(hashes))
                held.append(hashes)
                waiting += len(hashes)
                if waiting > HELD:
                    counts += count()
                    held, waiting = [], 0
            k1, k2 = zip(*keys, strict=True) if keys else ((), ())
            yield pd.DataFrame({"id": batch["id"], "k1": pd.Series(k1, dtype="int64"), "k2": pd.Series(k2, dtype="int64"), "n": pd.Series(sizes, dtype="int64"), "odd": odd, "counter": None, "count": None})
        if held:
            counts += count()
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"id": None, "k1": None, "k2": None, "n": None, "odd": None, "counter": some, "count": counts[some]})

    return docs.mapInPandas(describe, schema)


def _prefixes(docs: DataFrame, words: int, limit: Limit, shared) -> DataFrame:
    """A row for each n-gram of a text's prefix. N-grams that may be frequent are salted, others have salt -1."""

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = Order(*shared.value)
        usual = 2 * order.count.mean()
        for batch in batches:
            out, tokens, salts, held = [], [], [], 0
            for text in batch["text"]:
                hashes = ngram_hashes(text, words)
                n = len(hashes)
                if not n:
                    continue
                k1, k2 = set_key(hashes)
                sorted_, counters = order.sort(hashes)
                p = limit.prefix(n)
                odd = odd_bits(hashes, 128)
                rows = np.zeros(p, MEMBER)
                rows["k1"], rows["k2"], rows["n"], rows["pos"] = k1, k2, n, np.arange(p)
                rows["b1"], rows["b2"] = odd.view("<u8")
                # What a counter has beyond twice the mean may be one n-gram's.
                parts = 1 + np.maximum(order.count[counters[:p]] - usual, 0) // PER_TILE
                salts.append(np.where(parts > 1, (k1 & 0x7FFFFFFF) % parts, -1))
                tokens.append(sorted_[:p].view(np.int64))
                out.append(rows)
                held += p
                if held > HELD:
                    yield _prefix_frame(tokens, salts, out)
                    out, tokens, salts, held = [], [], [], 0
            if out:
                yield _prefix_frame(tokens, salts, out)

    return docs.select("text").mapInPandas(prefixes, "token long, salt int, k1 long, k2 long, b1 long, b2 long, n int, pos int")


def _prefix_frame(tokens: list[np.ndarray], salts: list[np.ndarray], rows: list[np.ndarray]) -> pd.DataFrame:
    found = np.concatenate(rows)
    return pd.DataFrame({"token": np.concatenate(tokens), "salt": np.concatenate(salts), **{c: found[c].view("<i8") if c in ("b1", "b2") else found[c] for c in MEMBER.names}})


def _members(batch: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(batch), MEMBER)
    for c in MEMBER.names:
        out[c] = batch[c].to_numpy(np.int64).view("<u8") if c in ("b1", "b2") else batch[c].to_numpy(np.int64)
    return out


TILE = "token long, tile long, rows binary"


def _groups(prefixes: DataFrame, limit: Limit) -> DataFrame:
    """What meets in an n-gram: pairs of small groups (kind 0: nearest of a member, 1: others), tiles of larger ones (kind 2).

    A partition is sorted by n-gram and streamed; what is held is a batch and a group or tile that is not finished.
    """

    def cut(tokens, salts, rows, number) -> Iterator[pd.DataFrame]:
        """Whole groups, sorted."""
        new = np.ones(len(rows), bool)
        same = (tokens[1:] == tokens[:-1]) & (salts[1:] == salts[:-1])
        copy = same & (rows["k1"][1:] == rows["k1"][:-1]) & (rows["k2"][1:] == rows["k2"][:-1])
        new[1:] = ~copy
        tokens, salts, rows = tokens[new], salts[new], rows[new]
        starts = np.flatnonzero(np.r_[True, (tokens[1:] != tokens[:-1]) | (salts[1:] != salts[:-1])])
        sizes = np.diff(np.r_[starts, len(rows)])
        group = np.repeat(np.arange(len(starts)), sizes)
        small = (sizes <= SMALL) & (salts[starts] < 0)
        in_small = small[group] & (sizes[group] > 1)
        ids, members = group[in_small], rows[in_small]
        pairs = []
        for step in range(1, SMALL):
            i = np.flatnonzero(ids[step:] == ids[:-step])
            if not len(i):
                break
            possible, differ = limit.possible(members[i], members[i + step])
            pairs.append((i[possible], i[possible] + step, differ[possible]))
        if pairs:
            i, j, differ = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield _pair_frame(members[i], members[j]).assign(kind=np.where(_nearest(i, j, differ), 0, 1), token=None, tile=None, rows=None)
        laid = [(tokens[starts[g]], rows[at : min(at + PER_TILE, starts[g] + sizes[g])].tobytes()) for g in np.flatnonzero(~small) for at in range(starts[g], starts[g] + sizes[g], PER_TILE)]
        if laid:
            of, held = zip(*laid, strict=True)
            yield pd.DataFrame({"kind": 2, "token": of, "tile": range(number[0], number[0] + len(laid)), "rows": held, "a1": None, "a2": None, "b1": None, "b2": None})
            number[0] += len(laid)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, long = [TaskContext.get().partitionId() << 40], None, None
        for batch in batches:
            now = (batch["token"].to_numpy(np.int64), batch["salt"].to_numpy(np.int64), _members(batch))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            tokens, salts, rows = held
            if not len(rows):
                continue
            # What is left of a long group belongs to tiles, however few rows it is.
            salts = np.where(tokens == long, np.maximum(salts, 0), salts)
            last = int(np.flatnonzero(np.r_[True, (tokens[1:] != tokens[:-1]) | (salts[1:] != salts[:-1])])[-1])
            held = (tokens, salts, rows)
            if len(rows) - last > 4 * PER_TILE:
                long = tokens[last]
                yield from cut(tokens, np.where(tokens == long, np.maximum(salts, 0), salts), rows, number)
                held = None
            elif last:
                yield from cut(tokens[:last], salts[:last], rows[:last], number)
                held = (tokens[last:], salts[last:], rows[last:])
        if held is not None and len(held[0]):
            yield from cut(held[0], np.where(held[0] == long, np.maximum(held[1], 0), held[1]), held[2], number)

    met = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "k1", "k2")
    return met.mapInPandas(stream, f"kind int, {PAIR}, {TILE}")


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """Every two tiles of an n-gram, once, and each with itself; those that lie in one component alone do not meet."""
    a = tiles.select("token", F.col("tile").alias("a_tile"), F.col("rows").alias("a_rows"), *[F.col(c).alias("a_" + c) for c in tiles.columns if c in ("low", "high", "labels")])
    pairs = a.join(tiles, "token").filter("a_tile <= tile")
    return pairs.filter("not (a_low = low and a_high = high and low = high)") if "low" in tiles.columns else pairs


def _compare(pairs: DataFrame, limit: Limit, nearest: bool) -> DataFrame:
    """Possible links between two tiles: the nearest of each member, or all between members of different components."""
    labelled = "labels" in pairs.columns

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a, b = np.frombuffer(r.a_rows, MEMBER), np.frombuffer(r.rows, MEMBER)
                la, lb = (np.frombuffer(r.a_labels, "<i8"), np.frombuffer(r.labels, "<i8")) if labelled else (None, None)
                found = []
                width = max(1, CELLS // len(b))
                for at in range(0, len(a), width):
                    some = a[at : at + width, None]
                    possible, differ = limit.possible(some, b[None, :])
                    if r.a_tile == r.tile:
                        possible &= np.arange(at, at + len(some))[:, None] < np.arange(len(b))[None, :]
                    if labelled:
                        possible &= la[at : at + width, None] != lb[None, :]
                    i, j = np.nonzero(possible)
                    found.append((i + at, j, differ[i, j]))
                i, j, differ = (np.concatenate(x) for x in zip(*found, strict=True))
                if nearest:
                    kept = _nearest(i, j, differ)
                    i, j = i[kept], j[kept]
                if len(i):
                    yield _pair_frame(a[i], b[j])

    columns = ["a_rows", "rows", "a_tile", "tile", *(["a_labels", "labels"] if labelled else [])]
    return pairs.select(*columns).mapInPandas(compare, PAIR)


def _node(first: str, second: str):
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (first, second)])


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(_node("a1", "a2").alias("a"), _node("b1", "b2").alias("b")).distinct()


def id_filter(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id may be among some: those whose hash's bit is set in a table of at most FILTER_BITS bits.

    The table is broadcast as 64-bit words, so its size is bounded however many ids there are; a few others pass too.
    """

    def placed(name: str):
        place = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
        return F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int")

    word, bit = placed("id")
    bits = ids.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    marked = docs.select("*", word, bit.alias("bit"))
    is_set = F.expr("shiftright(bits, bit) & 1L") == 1
    return marked.join(F.broadcast(bits), "word").filter(is_set).select(*docs.columns)


@dataclass
class _Texts:
    """Where the n-grams of a set are found again: the texts, and (node, n, odd, least) of each set, ``least`` being its least id."""

    docs: DataFrame
    sets: DataFrame
    words: int
    shared: object
    fragments: int

    def possible(self, pairs: DataFrame, limit: Limit) -> DataFrame:
        """The pairs that may be linked by all odd bits of their sets."""

        def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for x, y, total in zip(batch["a_odd"], batch["b_odd"], (batch["a_n"] + batch["b_n"]).tolist(), strict=True):
                    size = min(len(x), len(y))
                    differ = np.bitwise_count(fold(np.frombuffer(x, np.uint8), size) ^ fold(np.frombuffer(y, np.uint8), size)).sum()
                    keep.append(differ <= total - 2 * limit.overlap(total))
                yield batch.loc[keep, ["a", "b", "a_n", "b_n"]]

        for side in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("odd").alias(f"{side}_odd")), side)
        return pairs.mapInPandas(sieve, "a string, b string, a_n long, b_n long")

    def segments(self, nodes: DataFrame) -> DataFrame:
        """(node, fragment, grams): the sets of some nodes (node, least, n), cut by the fragments of the order."""
        words, shared = self.words, self.shared
        grams = nodes.agg(F.sum("n")).first()[0]

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            order = Order(*shared.value)
            for batch in batches:
                for text in batch["text"]:
                    hashes = ngram_hashes(text, words)
                    key = "".join(f"{k % (1 << 64):016X}" for k in set_key(hashes))
                    grams, counters = order.sort(hashes)
                    fragment = order.fragment[counters]
                    ends = np.flatnonzero(np.r_[fragment[1:] != fragment[:-1], True]) + 1 if len(grams) else []
                    parts = np.split(grams.view(np.int64), ends[:-1]) if len(grams) else []
                    yield pd.DataFrame({"node": key, "fragment": [int(fragment[e - 1]) for e in ends], "grams": parts})

        # One text for each set is enough, found by the least id that has it. The sets of the few other texts that
        # the filter lets pass are none of the nodes, or are found twice.
        near = id_filter(self.docs, nodes.select(F.col("least").cast("string").alias("id")))
        # Copies of a text leave a task as one row.
        texts = near.groupBy("id", F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text")).select("text")
        found = gathered(texts, grams).mapInPandas(cut, "node string, fragment int, grams array<long>").join(nodes, "node", "left_semi")
        return written(gathered(found.dropDuplicates(["node", "fragment"]), grams), "ngram-segments")

    def links(self, pairs: DataFrame, limit: Limit) -> DataFrame:
        """The pairs that are linked: partial overlaps are counted fragment by fragment and summed for each pair."""
        pairs = written(self.possible(pairs, limit), "ngram-candidates")
        rows = pairs.count()
        if not rows:
            return pairs.select("a", "b")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        nodes = written(gathered(self.sets.join(ends, "node", "left_semi").select("node", "least", "n"), 2 * rows), "ngram-nodes")
        segments = self.segments(nodes)
        both = pairs.select("a", "b", "a_n", "b_n", F.explode(F.sequence(F.lit(0), F.lit(self.fragments - 1))).alias("fragment"))
        for side in ("a", "b"):
            of_side = segments.select(F.col("node").alias(side), "fragment", F.col("grams").alias(f"{side}_grams"))
            if rows <= joins.HOT_ROWS:  # so no set is in as many pairs as make it hot
                both = both.join(of_side, [side, "fragment"])
            else:
                counts = pairs.groupBy(side).agg(F.count("*").alias("pairs"))
                both = join_to_one(both, of_side.join(counts, side), [side, "fragment"], "pairs")
        partial = both.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_grams", "b_grams")).alias("common"))
        total = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("a_n").alias("a_n"), F.min("b_n").alias("b_n"))
        linked = F.lit(limit.of) * F.col("common") >= F.lit(limit.at_least) * (F.col("a_n") + F.col("b_n") - F.col("common"))
        return written(gathered(total.filter(linked).select("a", "b"), rows), "ngram-links")


def _labelled_tiles(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of tiles laid out anew, in the order of their components, so that most tiles lie in one component."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for token, rows in zip(batch["token"], batch["rows"], strict=True):
                found = np.frombuffer(rows, MEMBER)
                yield pd.DataFrame({"token": token, **{c: found[c].view("<i8") for c in MEMBER.names}})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 40, None

        def lay_out(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal number
            for _, group in df.groupby("token", sort=False):
                for at in range(0, len(group), PER_TILE):
                    some, number = group.iloc[at : at + PER_TILE], number + 1
                    label = some["label"].to_numpy(np.int64)
                    yield pd.DataFrame({"token": [some["token"].iloc[0]], "tile": [number], "rows": [_members(some).tobytes()], "labels": [label.tobytes()], "low": [label.min()], "high": [label.max()]})

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= 4 * PER_TILE:
                yield from lay_out(held)
                held = None
        if held is not None and len(held):
            yield from lay_out(held)

    columns = ", ".join(f"{c} long" for c in MEMBER.names)
    members = tiles.mapInPandas(unpack, f"token long, {columns}").withColumn("node", _node("k1", "k2"))
    # A hash of the component's name is enough: two components that share one would only be compared less.
    label = F.xxhash64(F.coalesce("root", "node")).alias("label")
    placed = written(members.join(labels, "node", "left").select("token", *MEMBER.names, label), "ngram-members")
    ranged = placed.repartitionByRange("token", "label", "k1").sortWithinPartitions("token", "label", "k1")
    return written(ranged.mapInPandas(pack, f"{TILE}, labels binary, low long, high long"), "ngram-tiles")


def linked_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, at_least: int = 90, of: int = 100, fragments: int = 8
) -> DataFrame:
    """(id, n_shingles, component): documents whose sets of word n-grams have a Jaccard similarity of at_least / of or more.

    Texts with equal sets are one set from the start. All n-grams stand in one order, rarest first by a sketch of their counts
    over all texts; the order is cut into ``fragments`` of equal mass. Linked sets share an n-gram among the first few of each,
    so sets meet there, in small groups as they stream by and in tiles of large ones. Of the pairs that sizes, places and odd
    bits leave possible (128 bits where sets meet, then as many as suit their sizes), those that are nearest to one of the two come first: their overlaps are counted fragment by fragment,
    summed, and the links give components. Then all other possible pairs between different components are counted in
    the same way, so no link between components is missed, and a dense group makes few pairs.

    A component is named by its least id. Texts without words are linked with nothing and are their own component; so is a
    text without links. A null id names no component (null if there is no other). Repeated rows and ids keep a row each. An
    empty table gives no rows. N-grams are compared by 64-bit hashes and sets named by 128 bits, so two sets of n n-grams are
    mistaken with a chance of about n^2 / 2^64.
    """
    if not 0 < at_least <= of:
        raise ValueError("the limit must lie above 0 and not above 1")
    spark, limit = docs.sparkSession, Limit(at_least, of)
    # Ids go through Python as text, so that no null turns them into floating numbers.
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    described = written(_describe(docs, words), "ngram-sets")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    # As many rows as the sketch has counters, whatever the table's size.
    sketch = described.filter("counter is not null").groupBy("counter").agg(F.sum("count").alias("count")).toPandas()
    counts[sketch["counter"]] = sketch["count"]
    order = Order.of(counts, fragments)
    shared = spark.sparkContext.broadcast((order.count, order.place, order.fragment))
    prints = described.filter("n is not null").select(F.col("id").cast(id_type).alias("id"), "n", _node("k1", "k2").alias("node"))
    met = written(_groups(_prefixes(docs, words, limit, shared), limit), "ngram-met")
    distinct = described.filter("n > 0").groupBy(_node("k1", "k2").alias("node"))
    sets = distinct.agg(F.min("n").alias("n"), F.min("odd").alias("odd"), F.min(F.col("id").cast(id_type)).alias("least"), F.count("*").alias("rows"))
    sets = written(sets, "ngram-distinct")
    texts = _Texts(docs, sets, words, shared, fragments)
    pair, tiles = ["a1", "a2", "b1", "b2"], met.filter("kind = 2").select("token", "tile", "rows")
    first = met.filter("kind = 0").select(*pair).unionByName(_compare(_tile_pairs(tiles), limit, nearest=True))
    links = texts.links(_named(first), limit)
    labels = components(links, "a", "b")
    # What is left: possible pairs between components that are still different.
    a, b = labels.select(F.col("node").alias("a"), F.col("root").alias("a_root")), labels.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
    apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    more = _compare(_tile_pairs(_labelled_tiles(tiles, labels)), limit, nearest=False)
    rest = _named(met.filter("kind = 1").select(*pair).unionByName(more))
    rest = rest.join(a, "a", "left").join(b, "b", "left").filter(apart).select("a", "b")
    # The components found so far stand for their links.
    links = labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(texts.links(rest, limit))
    roots = components(links, "a", "b")
    sets, rows = sets.select("node", "least", "rows"), sets.count()
    sets = written(gathered(sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), rows), "ngram-roots")
    named = sets.groupBy("root").agg(F.min("least").alias("component"))
    of_set = written(gathered(sets.join(named, "root").select("node", "rows", "component"), rows), "ngram-components")
    linked = join_to_one(prints.filter("n > 0"), of_set, ["node"], "rows").select("id", "n", "component")
    out = linked.unionByName(prints.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component")
