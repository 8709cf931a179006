"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import written

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
STEP = 1 << 20
HASHES = 1 << 40
# Most languages whose counts are sent to every executor; more are joined by a shuffle.
SENT_LANGUAGES = 100_000
# Up to this multiple of the least cosine a text must also have few pairs and triples that are new to the language.
NEAR = 1.75


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed letter pairs and triples of a whole text; words are set apart by one space."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32)
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, len(codes), STEP):  # bounded extra memory for very long texts
        c = codes[max(0, at - 2) : at + STEP]
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        pair, triple = (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits) for h in (pair, triple))
        if at:
            pair = pair[1:]  # the first pair was counted with the step before
        counts += np.bincount(pair, minlength=1 << bits)
        counts += np.bincount(triple, minlength=1 << bits)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


@dataclass
class LanguageModel:
    """Centroids (buckets x centroids), the language of each, idf by bucket, and for each language the bounds by length class.

    ``least`` bounds the cosine from below, ``most`` the share of a text's pairs and triples that no text of the
    language had; ``seen`` tells which buckets one had.
    """

    bits: int
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    least: dict[str, list[float]]
    seen: dict[str, np.ndarray]
    most: dict[str, list[float]]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        buckets, counts = grams(text or "", self.bits)
        if not len(buckets) or not len(self.language):
            return UNKNOWN, 0.0, True
        weights = (1 + np.log(counts)) * self.idf[buckets]
        cosines = weights @ self.centroids[buckets] / np.linalg.norm(weights)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        name = str(self.language[best])
        size = int(counts.sum())
        unseen = float(counts[~self.seen[name][buckets]].sum()) / size
        least = at_length(self.least[name], len(buckets))
        return name, score, score < least or (score < NEAR * least and unseen > at_length(self.most[name], size))


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows that lie far apart."""
    chosen = [rows.sum(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        nearest = np.max([rows @ (c / (np.linalg.norm(c) or 1)) for c in chosen], axis=0)
        chosen.append(rows[int(np.argmin(nearest))])
    centroids = np.array([c / (np.linalg.norm(c) or 1) for c in chosen])
    for _ in range(rounds):
        owner = np.argmax(rows @ centroids.T, axis=1)
        sums = np.array([rows[owner == i].sum(axis=0) if (owner == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def at_length(bounds: list[float], size: int) -> float:
    """The bound at a size: straight between the middles of two classes, on a log scale."""
    return float(np.interp(np.log2(size) + 0.5, np.arange(len(bounds)), bounds))


def most_by_length(shares: np.ndarray, sizes: np.ndarray, bits: int, high: float, extra: float, enough: int) -> list[float]:
    """Bounds of a language's unseen shares by length class: the ``high`` quantile of a class and some more.

    That is ``extra`` for long texts and 2 / sqrt(n) for n pairs and triples where that is larger, as one rare name weighs
    more in a short text. A class with fewer than ``enough`` texts has the bound of the class below; the lowest class rejects nothing.
    """
    bounds, classes = [1.0], length_classes(sizes, bits)
    for c in range(1, bits + 2):
        own = shares[classes == c]
        bounds.append(min(bounds[-1], float(np.quantile(own, high)) + max(extra, 2 / 2 ** ((c - 0.5) / 2))) if len(own) >= enough else bounds[-1])
    return bounds


def length_classes(sizes: np.ndarray, bits: int) -> np.ndarray:
    return np.array([min(int(n).bit_length(), bits + 1) for n in sizes], int)


def pieces(text: str) -> list[str]:
    """The text and beginnings of it, from 8 letters up, each twice as long as the one before: short texts of every length."""
    return [text, *(text[: 1 << k] for k in range(3, 13) if 1 << k < len(text))]


def least_by_length(cosines: np.ndarray, sizes: np.ndarray, bits: int, slack: float, low: float, share: float, enough: int) -> list[float]:
    """Bounds of a language's cosines by the bit length of a text's number of distinct buckets.

    ``share`` times the ``low`` quantile of the sample's texts of a class. A class with fewer than ``enough`` texts has the
    bound of the class below; the lowest one is ``slack`` times the least cosine of all.
    """
    bounds, classes = [slack * float(cosines.min())], length_classes(sizes, bits)
    for c in range(1, bits + 2):
        own = cosines[classes == c]
        bounds.append(max(bounds[0], share * float(np.quantile(own, low))) if len(own) >= enough else bounds[-1])
    return bounds


def fit(
    labelled: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    per_language: int = 400,
    centroids: int = 3,
    bits: int = 14,
    slack: float = 0.25,
    low: float = 0.05,
    share: float = 0.5,
    enough: int = 20,
    high: float = 0.95,
    extra: float = 0.05,
) -> LanguageModel:
    """Centroids from at most ``per_language`` rows of each language, those with the least hashes of their ids.

    Rows with a null id, text or label, or without letters, teach nothing; of the rows of one id one teaches. A
    language's texts are rejected under a cosine for their length (``least_by_length``), and a little above it when too many
    of their pairs and triples are unknown to it (``most_by_length``); both bounds are learned from the sample's texts and their
    beginnings, the share unknown to all other texts of the sample standing for that of a new text. Only ids are
    ranked; texts become bucket counts on the executors, so at most ``per_language`` bounded vectors for each language
    and length reach the driver, which lays them out in full for one language at a time. ``bits`` goes up to 15.
    """
    if not 1 <= bits <= 15:
        raise ValueError("bits must lie between 1 and 15")
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(
        "id is not null and text is not null and label is not null"
    )
    # Hashes under a bound by the language's count leave about twice as many ids as are wanted, however many there are.
    sizes = written(rows.groupBy("label").agg(F.count("*").alias("rows")), "languages")
    if sizes.count() <= SENT_LANGUAGES:
        sizes = F.broadcast(sizes)
    place = F.pmod(F.xxhash64("id"), F.lit(HASHES))
    near = rows.select("id", "label").join(sizes, "label").filter(place / F.lit(HASHES) * F.col("rows") < 2 * per_language)
    order = Window.partitionBy("label").orderBy(place, "id")
    ids = near.groupBy("id").agg(F.min("label").alias("label"))
    sample = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                found = [grams(t, bits) for t in pieces(text)]
                out = pd.DataFrame({"label": label, "whole": [i == 0 for i in range(len(found))], "buckets": [f[0].astype("<i2").tobytes() for f in found], "counts": [f[1].astype("<i4").tobytes() for f in found]})
                yield out[out["buckets"].str.len() > 0]

    # At most one row of an id leaves a task.
    chosen = rows.join(F.broadcast(sample.select("id")), "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", F.xxhash64("text").alias("hash"), "text")).alias("row"))
    found = chosen.select("row.label", "row.text").mapInPandas(vectors, "label string, whole boolean, buckets binary, counts binary").toPandas()
    found = found.sort_values(["label", "whole", "buckets", "counts"], ascending=[True, False, True, True], ignore_index=True)
    n, width = int(found["whole"].sum()), 1 << bits
    texts_with = np.zeros(width, np.int64)
    for b in found["buckets"][found["whole"]]:
        texts_with[np.frombuffer(b, "<i2")] += 1
    idf = (np.log((1 + n) / (1 + texts_with)) + 1).astype(np.float32)
    means, names, least, seen, most = [], [], {}, {}, {}
    for label, at in sorted(found.groupby("label").indices.items()):
        name, whole = str(label), int(found["whole"].iloc[at].sum())
        texts = [(np.frombuffer(b, "<i2"), np.frombuffer(c, "<i4")) for b, c in found.iloc[at][["buckets", "counts"]].itertuples(index=False)]
        tf, own = np.zeros((whole, width), np.float32), np.zeros(width, np.int64)
        for row, (buckets, counts) in zip(tf, texts, strict=False):
            row[buckets] = (1 + np.log(counts)) * idf[buckets]
            own[buckets] += 1
        tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
        made = spherical_means(tf, centroids).astype(np.float32)
        means.extend(made)
        names.extend([name] * len(made))
        weights = [(1 + np.log(counts)) * idf[buckets] for buckets, counts in texts]
        cosines = np.array([(made[:, b] @ w).max() / np.linalg.norm(w) for (b, _), w in zip(texts, weights, strict=True)])
        sizes_of = np.array([counts.sum() for _, counts in texts])
        # What one text alone has is new to the others.
        shares = np.array([counts[own[buckets] < 2].sum() / counts.sum() for buckets, counts in texts])
        least[name] = least_by_length(cosines, np.array([len(b) for b, _ in texts]), bits, slack, low, share, enough)
        seen[name], most[name] = own > 0, most_by_length(shares, sizes_of, bits, high, extra, enough)
    matrix = np.array(means, np.float32).reshape(len(names), width).T
    return LanguageModel(bits, idf, np.ascontiguousarray(matrix), np.array(names), least, seen, most)


def predict(spark, model: LanguageModel, text: Column) -> Column:
    """struct(lang, score, rejected) of a text column.

    A null text, or one without letters, is ``und`` with score 0 and rejected, as is any text when nothing was
    learned. Ties go to the language that comes first. Whole texts count; repeated rows are scored alike.
    """
    shared = spark.sparkContext.broadcast(vars(model))

    @F.pandas_udf("lang string, score double, rejected boolean")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = LanguageModel(**shared.value)
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang", "score", "rejected"])

    return scored(text)
