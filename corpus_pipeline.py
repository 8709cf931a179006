"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that its predecessor kept, as a table. Parquet between the stages cuts the
lineage; ``run`` writes below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import language, packing, simhash, toxicity
from folioscan.llm.queries import language_model, toxicity_model, with_words
from folioscan.session import written
from folioscan.sources.tables import parquet_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are near a centroid of some language; those without letters or far from all of them go."""
    found = language.predict(spark, language_model(docs), F.col("text"))
    return docs.filter(~found["rejected"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents scored at a half or more."""
    model = toxicity_model(docs, parquet_table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(spark, model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group: three-word shingles, at most three differing bits."""
    return simhash.one_of_each(docs, words=3, radius=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 512 to 4,096 words."""
    return packing.best_fit_pack(with_words(docs))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

# Learned models, SimHash and best fit are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
