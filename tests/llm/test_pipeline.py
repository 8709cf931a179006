from collections import Counter

import corpus_pipeline
from folioscan.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_each_stage_against_its_operator(spark):
    """Every decision of a stage, recomputed from the rows before it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "simhash_near_dedup", "best_fit_packing"]
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, kept[-1], FOLDER).collect(), docs.schema)
        assert out.columns == columns
        kept.append(out)
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert [k.count() for k in kept] == [len(i) for i in ids] and all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    rejected = {r.doc_id for r in QUERIES["op4_language_id"](spark, FOLDER).filter("rejected").collect()}
    assert ids[1] == ids[0] - rejected
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 1").collect()}
    gone = ids[1] - ids[2]
    assert len(gone & toxic) > 0.7 * len(toxic) and len(gone - toxic) < 0.05 * len(ids[1])
    from test_simhash import groups, near, slow_hash

    prints = {r.doc_id: slow_hash(r.text) for r in kept[2].collect()}
    values = sorted(set(prints.values()))
    least = groups(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if near(a, b)])
    first = {}
    for i in sorted(prints):
        first.setdefault(least[prints[i]], i)
    assert ids[3] == set(first.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[3], FOLDER).collect()
    words = Counter()
    for r in packed:
        words[r.doc_id] += r.length
    expected = {r.doc_id: len(r.text.encode().split()) for r in kept[3].collect()}
    assert dict(words) == {i: n for i, n in expected.items() if n}
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(words)


def test_odd_documents_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (None, "the of and", "en", "s", 3), (2, "", "en", "s", 0), (3, "the of and", "en", "s", 3), (3, "the of and", "en", "s", 3), (4, "!!", "de", "s", 2)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, fp string")
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, FOLDER)
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, out, FOLDER).count() == (1 if frame is docs else 0)
