"""Order-independent document fingerprints: a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A fingerprint: 8 lanes summed modulo 2**64 for equality, then 128 lanes of +1 or -1 summed modulo 2**16 for likeness.
WIDE, SIGNS = 8, 128


SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n")


def paragraphs(text: str) -> list[str]:
    """The lines of a text, taken sentence by sentence and trimmed; empty ones are none.

    So an edit within a long paragraph changes the fingerprint by the sentences that it touches.
    """
    return [p for part in SENTENCE_END.split(text) if (p := part.strip())]


class Fingerprint:
    """A sum of hashed paragraphs that they can be added to and taken from in any order."""

    __slots__ = ("signs", "wide")

    def __init__(self, texts: Iterable[str] = ()) -> None:
        self.wide = np.zeros(WIDE, np.uint64)
        self.signs = np.zeros(SIGNS, np.int16)
        self.add(texts)

    @staticmethod
    def _sum(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join([hashlib.blake2b(t.encode("utf-8", "surrogatepass")).digest() for t in texts])
        digests = np.frombuffer(data, np.uint8).reshape(-1, 64)
        wide = digests.view("<u8").sum(axis=0, dtype=np.uint64)
        ones = np.unpackbits(digests[:, :16], axis=1).sum(axis=0, dtype=np.int64)
        return wide, (2 * ones - len(digests)).astype(np.int16)

    def add(self, texts: Iterable[str]) -> Fingerprint:
        wide, signs = self._sum(texts)
        self.wide = self.wide + wide
        self.signs = self.signs + signs
        return self

    def remove(self, texts: Iterable[str]) -> Fingerprint:
        wide, signs = self._sum(texts)
        self.wide = self.wide - wide
        self.signs = self.signs - signs
        return self

    def copy(self) -> Fingerprint:
        other = Fingerprint.__new__(Fingerprint)
        other.wide, other.signs = self.wide, self.signs
        return other

    def text(self) -> str:
        return self.wide.astype("<u8").tobytes().hex() + self.signs.astype("<i2").tobytes().hex()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.text() == other.text()

    def __hash__(self) -> int:
        return hash(self.text())


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """About twice the shared paragraphs over all paragraphs of both, 1 for equal fingerprints.

    The mean square of the sign lanes estimates the squared length of a multiset, and the lanes of a
    difference are the difference of the lanes.
    """
    if a == b:
        return 1.0
    x, y, apart = (v.astype(np.float64) for v in (a.signs, b.signs, a.signs - b.signs))
    whole = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1.0 - float(apart @ apart) / whole)) if whole else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as many first characters of another, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_fingerprint(own: Fingerprint, text: str, changed: str, keep: int) -> Fingerprint:
    """Fingerprint of ``changed``, which shares its first ``keep`` characters with ``text``: only lines from there on are exchanged."""
    cut = text.rfind("\n", 0, keep) + 1
    return own.copy().remove(paragraphs(text[cut:])).add(paragraphs(changed[cut:]))


def in_segments(docs: DataFrame, id_col: str, text_col: str, segments: int) -> DataFrame:
    """Rows in descending order of id, cut into segments, each followed by a copy of the first row of the next one.

    Cut points are ids of the table, found from the ids alone. A row at a cut is sent to both segments that
    meet there, so every row stands beside the next one without an order over the whole table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / segments for i in range(1, segments)]
    found = rows.agg(F.percentile_approx("id", shares or [0.5], 10 * segments).alias("cuts"), F.max("id").alias("top"), F.min("id").alias("low")).first()
    cuts = sorted(set(found["cuts"] or []) | {found["top"], found["low"]} - {None}) if shares else []
    # Two levels, so that a row is compared with few of the cuts.
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def longs(values):
        return F.array(*[F.lit(v).cast("long") for v in values])

    id_ = F.col("id")
    if groups:
        coarse = F.size(F.filter(longs([g[-1] for g in groups]), lambda c: c < id_))
        inner = F.element_at(F.array(*[longs(g) for g in groups]), F.least(coarse + 1, F.lit(len(groups))))
        low = F.when(coarse >= len(groups), len(cuts)).otherwise(coarse * width + F.size(F.filter(inner, lambda c: c < id_)))
        is_cut = F.coalesce(F.array_contains(inner, id_), F.lit(False))
    else:
        low, is_cut = F.lit(0), F.lit(False)
    # Segment s holds ids in (cuts[s-1], cuts[s]]; the largest of them also ends the segment above. Null ids end the last one.
    segment = F.when(id_.isNull(), 0).otherwise(low).cast("int")
    both = F.when(is_cut, F.array(segment, segment + 1)).otherwise(F.array(segment))
    return rows.select("id", "text", segment.alias("own"), F.explode(both).alias("segment"))


def _pairs(batches: Iterator[pd.DataFrame], first: str) -> Iterator[tuple[int, str, str]]:
    """(id, text, next text) of the own rows of each segment; rows come in order."""
    previous: deque = deque(maxlen=1)
    for batch in batches:
        for row in zip(batch["segment"], batch["own"], batch["id"], batch["text"], strict=True):
            if previous:
                segment, own, id_, text = previous[0]
                if own == segment:
                    yield id_, text, (row[3] if row[0] == segment else first)
            previous.append(row)
    if previous and previous[0][0] == previous[0][1]:
        yield previous[0][2], previous[0][3], first


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None) -> DataFrame:
    """Fingerprints of each document, of its edited text (see ``edited``) and its likeness to both neighbours.

    The next document is that of the next smaller id; after the last comes the first. Null texts are empty
    texts; rows of one id follow each other in descending order of their text; rows with a null id come last.
    A single document is its own next one. Texts without paragraphs have the fingerprint of the empty
    multiset. An empty table gives no rows.
    """
    spark = docs.sparkSession
    segments = segments or max(2, docs.sparkSession.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # More segments than tasks, so that tasks get about as many rows each.
    rows = in_segments(docs, id_col, text_col, 8 * segments)
    order = [F.desc("segment"), F.desc_nulls_last("id"), F.desc("text")]
    # The first document follows the last one: one row, found by a top-1 over the ids.
    head = docs.agg(F.max_by(F.coalesce(F.col(text_col), F.lit("")), F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))).first()[0]
    shared = spark.sparkContext.broadcast(head or "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        following: tuple[str, Fingerprint] | None = None
        for id_, text, after in _pairs(batches, shared.value):
            own = following[1] if following and following[0] == text else Fingerprint(paragraphs(text))
            nxt = Fingerprint(paragraphs(after))
            following = (after, nxt)
            changed = edited(text, after)
            other = edited_fingerprint(own, text, changed, len(text) - len(text) // 2)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((id_, len(text), sha, own.text(), other.text(), likeness(own, other), likeness(own, nxt)))
            if len(out) == 2000:
                yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    names = ["id", *[c.split()[0] for c in COLUMNS.split(", ")]]
    dealt = rows.repartition(segments, "segment").sortWithinPartitions(*order)
    return dealt.mapInPandas(run, f"id long, {COLUMNS}").withColumnRenamed("id", id_col)
