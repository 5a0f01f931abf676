"""The operators of this package as registered queries, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, license, simhash, substring, topk, toxicity, urlfilter, warc
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    return langid.identify(docs.drop("lang"), langid.train(docs.where(~F.col("held_out"))))


def op2_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def op3_exact_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


OP3_SQL = """
WITH v AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 64) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def op4_url_filter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark, sf_dir):
    return substring.removal_digest(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS b FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, b, row_number() OVER (PARTITION BY array_to_string(ws[b:b + 19], ' ') ORDER BY doc_id, b) AS nth FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, b + 20)) AS pos FROM k WHERE nth > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS line, count(*) AS n FROM words LEFT JOIN gone USING (doc_id, pos) WHERE gone.pos IS NULL GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def op7_license_scan(spark, sf_dir):
    return license.scan(table(spark, sf_dir, "documents"))


def rank_file() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark, sf_dir):
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), *rank_file())


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    marks = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    model = toxicity.train(docs, marks)
    return toxicity.score(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_language, op2_warc, op3_exact_topk, op4_url_filter, op5_decontamination, op6_substring_dedup, op7_license_scan, op8_byte_bpe, op9_toxicity, op10_simhash)}
ORACLES = {"op2_warc": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op3_exact_topk": OP3_SQL, "op4_url_filter": urlfilter.oracle()}
