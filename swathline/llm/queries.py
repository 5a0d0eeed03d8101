"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, html_text, language, licenses, minhash, ngram, pieces, pii, warc
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(index, index._warc_root).drop("payload")


def op3_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram.train(ngram.training(docs))
    rows = ngram.score(docs, model)
    total = F.lit(model["words"][2]).cast("long").alias("train_tokens")
    return rows.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", total, "base_score", "score")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = F.col("decoded").eqNullSafe(F.translate("text", pieces.SPACE, " "))
    return rows.select("doc_id", F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")).cast("long").alias("n_pieces"), "pieces", same.alias("round_trip"))


def language_model(docs: DataFrame) -> dict:
    """Trained on the documents outside the held-out fold."""
    return language.fit(docs.where(fold(F.col("doc_id"), 4) != 2), F.col("text"), F.col("lang"), F.xxhash64("doc_id"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language.identify(docs, language_model(docs), keep=["doc_id"])
    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    many = lambda i, k: F.size(F.filter("_base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{k}")
    counts = [many(i, k) for i, (k, _) in enumerate(pii.BASE)]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("_base")), 256).alias("base_sha256"), pii.joined(F.col("_spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_warc, op3_ngram, op4_html_text, op5_pieces, op6_language, op7_minhash, op8_decontamination, op9_itq, op10_pii)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Pairs (x, y) of one component each way, by steps along links (a, b).
_REACH = """u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)"""

SQL = {
    "op7_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM e p JOIN e q USING (x) WHERE p.doc_id < q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * k >= 75 * (len(p.g) + len(q.g) - k)),
{_REACH}
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON x = doc_id
""",
    "op9_itq": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id WHERE CASE WHEN len(p.e) = len(q.e) THEN list_cosine_similarity(p.e, q.e) >= 0.93 ELSE false END),
{_REACH},
n AS (SELECT a, count(*) AS many FROM u GROUP BY a)
SELECT vec_id, coalesce(many, 0) AS n_links, CAST(coalesce(least, vec_id) AS BIGINT) AS component_id, coalesce(least, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON x = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op2_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item, 10 AS n, w[s:s + 9] AS g FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS s FROM i WHERE len(w) >= 10)
  UNION SELECT item, len(w), w FROM i WHERE len(w) BETWEEN 1 AND 9),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, s, w[s:s + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, s, item FROM grams JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
