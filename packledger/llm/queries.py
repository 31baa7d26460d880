"""The operators as registered queries over their whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import dialogues, harmonic, hnsw, langid, main_text, mixing, packing, pitman_yor, secret_scan, simhash, tokenfile, topk, walsh, word_contexts
from .common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled rows outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs.where(langid.learnable())))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of every document in the interleaved sources, under tempered weights."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to seekable files and read back."""
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with counts and a digest of the plain patterns' spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the model of those outside the held-out seventh."""
    docs = table(spark, sf_dir, "documents")
    return word_contexts.score(docs, word_contexts.fit(docs.where(~pitman_yor.held_out())))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours by cosine of every fiftieth vector."""
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return packing.digests(table(spark, sf_dir, "documents"))


def op10_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest inner products of every fiftieth vector, in whole numbers."""
    return topk.inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and a digest of the repair of every conversation, damaged by a checksum first."""
    conversations = table(spark, sf_dir, "conversations")
    return dialogues.audited(conversations, dialogues.damaged(conversations))


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences without padding."""
    return harmonic.digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by their nearest entries of learned codebooks, with errors."""
    return walsh.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_near_duplicates, op3_main_text, op4_source_mix, op5_token_files, op6_secrets, op7_lm_score,
    op8_neighbours, op9_packing, op10_inner_products, op11_dialogue_repair,
    op12_harmonic_packing, op13_vector_codes)}

#: Every query against every row, without bounds or shards.
_PRODUCTS = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v),
                 lambda p: p[1] * p[2]))::BIGINT AS score
          FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

ORACLE = {"op4_source_mix": mixing.SQL, "op10_inner_products": _PRODUCTS, "op13_vector_codes": walsh.SQL}
