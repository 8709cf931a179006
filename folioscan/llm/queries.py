"""One query per operator over its whole table, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import bpe, fingerprints, html_text, language, ngram_join, packing, simhash, topk, toxicity, trie, url_rules, warc, whitening
from folioscan.session import scratch_path
from folioscan.sources.tables import parquet_table

TOKENIZER = "byte_bpe_50k.json"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed package of public tokenizers keeps a file; read on the driver only."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bucket(id_col: str, modulus: int):
    return F.crc32(F.col(id_col).cast("string")) % modulus


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = parquet_table(spark, folder, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = parquet_table(spark, folder, "pages")
    texts = pages.select("page_id", "url", html_text.extract_text("html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_tokens", F.regexp_count("text", F.lit(WORD)).cast("long"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = parquet_table(spark, folder, "documents")
    return packing.best_fit_pack(with_words(docs.select("doc_id", "text")))


def language_model(docs: DataFrame) -> language.LanguageModel:
    return language.fit(docs.filter(bucket("doc_id", 4) != 2), "doc_id", "text", "lang")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = parquet_table(spark, folder, "documents")
    found = docs.select("doc_id", language.predict(spark, language_model(docs), F.col("text")).alias("found"))
    held_out = F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_edits(parquet_table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(parquet_table(spark, folder, "pages"), path, least=1000)
    # Archives of one's own have no damage: a gap fails the query, as it would stand for lost pages.
    sound = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("gap in"), "file", F.lit("at"), "offset", "reason")).cast("boolean"))
    found = warc.read_warc(spark, path, with_payload=False).filter(sound)
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(parquet_table(spark, folder, "documents"), words=3, radius=3)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = parquet_table(spark, folder, "documents")
    vocabulary = bpe.load_vocabulary(tokenizer_path())
    encoded = docs.select("doc_id", bpe.encode(spark, vocabulary, F.col("text")).alias("ids"))
    # The two steps stay apart: coalesce keeps Spark from encoding again inside the decoding step.
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    decoded = bpe.decode(spark, vocabulary, ids)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled documents of the training part; only their ids are joined before the sample is taken."""
    known = labels.select(F.col("doc_id"), F.col("toxic")).filter(bucket("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return toxicity.fit(docs.select("doc_id", "text").join(known, "doc_id"), "doc_id", "text", "toxic")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = parquet_table(spark, folder, "documents")
    model = toxicity_model(docs, parquet_table(spark, folder, "labels"))
    scored = docs.select("doc_id", toxicity.score(spark, model, F.col("text")).alias("score"))
    held_out = F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(parquet_table(spark, folder, "pages"), RULES)


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.linked_documents(parquet_table(spark, folder, "documents"), words=3, at_least=90, of=100)
    return found.withColumnRenamed("component", "component_id")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.ordered_turns(parquet_table(spark, folder, "conversations"))
    return trie.prefix_trie(*trie.with_shared_heads(turns, share=5, most=9))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(parquet_table(spark, folder, "embeddings"), components=16, scale=64.0, shift=1_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_html_text, op3_best_fit_packing, op4_language_id, op5_fingerprints,
        op6_warc, op7_simhash, op8_bpe, op9_toxicity, op10_url_filter,
        op11_ngram_join, op12_prefix_trie, op13_whitening,
    )
}

ORACLES = {
    "op1_topk_search": """
WITH parts AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM parts
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, CAST(octet_length(encode(body)) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
FROM g""",
    "op10_url_filter": """
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, rh, rp)),
fits AS (SELECT u.*, r.verdict, rh, rp, rh || rp AS rule FROM u LEFT JOIN r
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(rh) DESC) AS n FROM fits) WHERE n = 1""",
    "op11_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (max(na.n) + max(nb.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""",
    "op12_prefix_trie": """
WITH ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), 4294967295), 4294967295) % 9 AS h FROM ids),
o AS (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
pieces AS (SELECT h.c, 0 AS part, i, turn FROM h JOIN o ON o.c = h.c - h.c % 5 AND o.i <= h.h UNION ALL SELECT h.c, 1, i, turn FROM h JOIN o ON o.c = h.c AND o.i > h.h),
seqs AS (SELECT ids.c, coalesce(list(turn ORDER BY part, i) FILTER (turn IS NOT NULL), []) AS s FROM ids LEFT JOIN pieces ON pieces.c = ids.c GROUP BY ids.c),
p AS (SELECT c, d, s[:d] AS prefix, len(s) AS size, s[d] AS turn FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, prefix, min(c) AS rep, count(*) AS n_convs, max(CASE WHEN d > 0 THEN octet_length(encode(turn.t)) ELSE 0 END) AS bytes,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '') AS ends FROM p GROUP BY d, prefix),
named AS (SELECT n.*, parents.rep AS parent, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.prefix[:n.d] = n.prefix) AS kids
  FROM nodes n LEFT JOIN nodes parents ON parents.d = n.d - 1 AND n.prefix[:n.d - 1] = parents.prefix),
up AS (SELECT u.kids, u.n_convs, u.bytes, a.d, a.prefix FROM named u JOIN p a ON a.c = u.rep AND a.d <= u.d)
SELECT rep AS conv_id, d AS depth, parent AS parent_conv_id, named.n_convs, kids AS n_children, sums.n_leaves, sums.saved_tokens, sha256(ends) AS ends_sha256
FROM named JOIN (SELECT d, prefix, count(*) FILTER (kids = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM up GROUP BY d, prefix) sums USING (d, prefix)""",
}
