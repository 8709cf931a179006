import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import language
from folioscan.llm.queries import QUERIES, language_model

SCHEMA = "doc_id long, text string, lang string, score double, label string"
ROWS = [(i, f"the cat and the dog number {'abcdefghij'[i % 10]} sat there", "en", 0.0, "") for i in range(40)]
ROWS += [(100 + i, f"der hund und die katze nummer {'abcdefghij'[i % 10]} lagen dort", "de", 0.0, "") for i in range(40)]


def test_held_out_accuracy(spark):
    found = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").alias("f").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.01


def test_odd_rows(spark, table):
    odd = [(500, None, None, 0.0, ""), (501, "", "en", 0.0, ""), (502, "12 34 !?", "de", 0.0, ""), (None, "the dog and the cat", "en", 0.0, ""),
           (503, "ყველა ადამიანი იბადება თავისუფალი", None, 0.0, ""), (504, "the dog and the cat " * 50_000, "en", 0.0, ""), (0, ROWS[0][1], "en", 0.0, "")]
    docs = table(ROWS + odd, SCHEMA)
    model = language.fit(docs, "doc_id", "text", "lang")
    found = {r[0]: tuple(r[1]) for r in docs.select("doc_id", language.predict(spark, model, F.col("text"))).collect()}
    assert found[500] == found[501] == found[502] == ("und", 0.0, True)
    assert found[None][0] == found[504][0] == found[0][0] == "en" and not found[504][2]
    assert found[503][2] and found[120][0] == "de"


def test_width_of_buckets(spark, table):
    docs = table(ROWS, SCHEMA)
    with pytest.raises(ValueError):
        language.fit(docs, "doc_id", "text", "lang", bits=16)
    model = language.fit(docs, "doc_id", "text", "lang", bits=15)
    assert model.predict("der hund und die katze")[0] == "de" and model.centroids.shape == (1 << 15, 6)


def test_nothing_learned(spark, table):
    model = language.fit(table([], SCHEMA), "doc_id", "text", "lang")
    docs = table([(1, "some text", "en", 0.0, "")], SCHEMA)
    assert tuple(docs.select(language.predict(spark, model, F.col("text"))).first()[0]) == ("und", 0.0, True)


def test_long_texts_count_as_in_one_step(monkeypatch):
    text = "Grüße aus der Stadt, 12 mal! " * 50
    whole = language.grams(text, 14)
    monkeypatch.setattr(language, "STEP", 17)
    parts = language.grams(text, 14)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_centroids_are_unit_vectors_of_clusters():
    rows = np.array([[1, 0.1], [1, 0], [0, 1], [0.1, 1]])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    made = language.spherical_means(rows, 2)
    assert np.allclose(np.linalg.norm(made, axis=1), 1) and sorted(np.argmax(rows @ made.T, axis=1).tolist()) in ([0, 0, 1, 1],)


UNLEARNED = [
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. ",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ",
]


def test_long_texts_of_unlearned_languages_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_model(docs)
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (50, 200, 1000)]
    noise += ["".join(rng.choices(letters, k=n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef") for n in (1200, 6000)]
    for text in [u * n for u in UNLEARNED for n in (1, 4)] + noise:
        assert model.predict(text)[2], (text[:40], model.predict(text))
    found = docs.filter("text is not null").select("text", language.predict(spark, model, F.col("text")).alias("p")).select("p.*", F.length("text").alias("n")).toPandas()
    print("rejected", int(found.rejected.sum()), "of", len(found), found[found.rejected].n.tolist())
    assert found.rejected.mean() < 0.001


def test_bounds_grow_with_length_and_ignore_a_junk_row():
    cosines, sizes = np.array([0.3] * 40 + [0.8] * 40 + [0.05]), np.array([40] * 40 + [600] * 40 + [600])
    bounds = language.least_by_length(cosines, sizes, 14, 0.25, 0.05, 0.5, 20)
    assert np.allclose(bounds[:6], 0.0125) and np.allclose(bounds[6:10], 0.15) and np.allclose(bounds[10:], 0.4) and len(bounds) == 16
