import numpy as np
from pyspark.sql import functions as F

from folioscan.llm import toxicity
from folioscan.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, toxic int, score double, label int"


def test_held_out_scores(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op9_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    print("auc", auc, "recall", (pos >= 0.5).mean(), "false alarms", (neg >= 0.5).mean())
    assert auc > 0.93 and (pos >= 0.5).mean() > 0.8 and (neg >= 0.5).mean() < 0.01


def test_weights_are_sparse_and_find_the_words():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    hashes = toxicity.WordHashes()
    texts, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 30))
        if i % 4 == 0:
            text[5] = "vile"
        texts.append(" ".join(text))
        labels.append(i % 4 == 0)
    rows = [toxicity.features(t, 18, hashes) for t in texts]
    model = toxicity.ftrl(rows, np.array(labels, float), 18, 2.0, 1.0, 8.0, 0.0, 6)
    assert 0 < len(model.buckets) < 200
    assert model.dense()[toxicity.features("vile", 18, hashes)].sum() > 1


def test_odd_rows(spark, table):
    rows = [(i, "you are vile and bad" if i % 2 else "what a nice day it is", i % 2, 0.0, 0) for i in range(80)]
    odd = [(None, "x", 1, 0.0, 0), (900, None, 1, 0.0, 0), (901, "", 0, 0.0, 0), (902, "nice day", None, 0.0, 0), (903, "so vile " * 50_000, None, 0.0, 0), (903, "so vile " * 50_000, None, 0.0, 0)]
    docs = table(rows + odd, SCHEMA)
    model = toxicity.fit(docs, "doc_id", "text", "toxic")
    found = docs.select("doc_id", toxicity.score(spark, model, F.col("text")).alias("s")).collect()
    scores = {r.doc_id: r.s for r in found}
    assert len(found) == len(rows) + len(odd) and all(0 <= s <= 1 for s in scores.values())
    assert scores[900] == scores[901] < 0.5 and scores[1] > 0.5 > scores[2]


def test_nothing_learned(spark, table):
    model = toxicity.fit(table([], SCHEMA), "doc_id", "text", "toxic")
    docs = table([(1, "some text", 0, 0.0, 0)], SCHEMA)
    assert docs.select(toxicity.score(spark, model, F.col("text"))).first()[0] < 0.5
