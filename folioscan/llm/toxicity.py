"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+").findall
KNOWN_WORDS = 400_000


class WordHashes(dict):
    """Word -> 32-bit hash; at most ``KNOWN_WORDS`` are kept at a time."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h >> np.uint32(32 - bits)


def features(text: str, bits: int, hashes: WordHashes) -> np.ndarray:
    """Distinct buckets of a whole text's words, word pairs, and pairs with one word left out."""
    words = WORDS(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint32, len(words))
    pair = h[:-1] * np.uint32(0x9E3779B1) + (h[1:] ^ np.uint32(0x5BD1E995))
    skip = h[:-2] * np.uint32(0x85EBCA77) + (h[2:] ^ np.uint32(0x3C6EF372))
    return np.unique(_mixed(np.concatenate([h, pair, skip]), bits)).astype(np.int64)


@dataclass
class ToxicityModel:
    """Sparse weights by bucket, and the bias."""

    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.buckets] = self.weights
        return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, weight: float = 1.0) -> ToxicityModel:
    """FTRL-proximal: every bucket has its own rate from its past gradients, and no weight while these stay within ``l1``.

    Gradients of rows of label 1 count ``weight`` times.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = weights(z[row], n[row])
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - y) * (weight if y else 1.0)
            step = (np.sqrt(n[row] + g * g) - np.sqrt(n[row])) / alpha
            z[row] += g - step * w
            n[row] += g * g
            bias_z += g - (((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha) * bias
            bias_n += g * g
    w = weights(z, n)
    used = np.flatnonzero(w)
    return ToxicityModel(bits, used, w[used].astype(np.float32), float(-bias_z / ((beta + bias_n**0.5) / alpha)))


def fit(
    labelled: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int = 12_000, bits: int = 20,
    alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 6, weight: float = 1.0,
) -> ToxicityModel:
    """Learn from at most ``most_rows`` labelled rows, those with the least hashes of their ids, in that order.

    Rows with a null id, text or label teach nothing; labels other than 0 count as 1. Of the rows of one id one
    teaches, that with the least hash of its text. Only ids are ranked; texts become bucket numbers on the executors.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(
        "id is not null and text is not null and label is not null"
    )
    least = F.broadcast(rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most_rows))
    # At most one row of an id leaves a task.
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), (F.col("label") != 0).cast("int").alias("label"), "text")).alias("row")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            data = [features(t, bits, hashes).astype("<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"h": batch["h"], "label": batch["label"], "data": data})

    found = (
        rows.join(least, "id", "left_semi")
        .groupBy("id")
        .agg(first)
        .select(F.xxhash64("id").alias("h"), "row.label", "row.text")
        .mapInPandas(vectors, "h long, label int, data binary")
        .toPandas()
        .sort_values(["h", "label", "data"], ignore_index=True)
    )
    data = [np.frombuffer(d, "<i4") for d in found["data"]]
    return ftrl(data, found["label"].to_numpy(float), bits, alpha, beta, l1, l2, epochs, weight)


def score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """Probability (double) that a whole text is toxic. Null and empty texts get the bias alone, or less than a half."""
    shared = spark.sparkContext.broadcast(vars(model))

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, hashes = ToxicityModel(**shared.value), WordHashes()
        weights, bias, bits = model.dense(), min(model.bias, -1e-9), model.bits
        for batch in texts:
            sums = np.array([weights[features(t, bits, hashes)].sum() if t else 0.0 for t in batch], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums + bias, -700, 700))))

    return scores(text)
