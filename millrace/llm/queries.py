"""The operators' queries with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.common import own_dir, table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.embedding_dedup import embedding_components
from millrace.llm.langid import Model, fold, identify, train
from millrace.llm.licenses import license_scan
from millrace.llm.packing import pack_documents
from millrace.llm.quality import quality
from millrace.llm.simhash import simhash_components
from millrace.llm.token_counts import token_counts
from millrace.llm.token_store import read_digests, write_store


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents whose fold of five is not 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.train(docs.join(labels.filter(fold("doc_id", 5) != 0), "doc_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_dir(spark)}/store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path).withColumnRenamed("id", "doc_id")


def language_model(spark: SparkSession, sf_dir: str) -> Model:
    """Learned from the documents whose fold of three is not 1."""
    return train(table(spark, sf_dir, "documents").filter(fold("doc_id", 3) != 1))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("n_detections", F.size("detections")).drop("detections")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_best_fit_packing, op4_token_store, op5_language_id, op6_simhash, op7_quality, op8_token_counts, op9_decontamination, op10_license_scan)}


#: Pairs of equal label by cosine, and what links reach from each vector.
OP1_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        low AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.c AS component_id, vec_id = low.c AS kept FROM v JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: Every window of every item against every window of as many words of every document.
OP9_SQL = r"""
    WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
        j AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
        k AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM j),
        e AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
        h AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM e) JOIN k USING (n, t)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
        x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for two operators; models, tokenizers, seeded hashes and packing are beyond it, and tests/llm uses brute force."""
    return {"op1_embedding_dedup": OP1_SQL, "op9_decontamination": OP9_SQL}
