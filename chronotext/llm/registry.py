"""The registered queries of the numbered operators and of the pipeline, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chronotext.llm import bitslice, bpe, embed_dedup, exact_dedup, lexical, licenses, manifest, mixing, quality, sharding, simhash, toxicity, url_filter
from chronotext.llm.shared import remainder, scratch, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    rows = docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    return toxicity.score(rows, model)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards near equal in bytes; the map of a data folder is kept, and edited when the query runs again."""
    folder = f"{scratch(spark)}/slot-maps/{sha256(sf_dir.encode()).hexdigest()}"
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), folder)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license_sequence", "licenses", "n_notices")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; drawn by the quality that the classifier gives it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    rows = mixing.mix(scored, weight=mixing.quality_weight(F.col("score")), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    rows = bpe.transcode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of equal texts stays, for every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.listed(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    rows = docs.withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    return quality.score(rows, model).drop("text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document."""
    return manifest.proofs(manifest.build(table(spark, sf_dir, "documents")))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every vector whose id is divisible by 50."""
    return bitslice.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_sharding, op3_licenses, op4_simhash, op5_mixing, op6_bpe, op7_exact_dedup, op8_embedding_dedup, op9_url_filter, op10_quality, op11_lexical_search, op12_manifest, op13_topk]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    exact = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
    out = {"op3_licenses": licenses.oracle(), "op7_exact_dedup": exact, "op9_url_filter": url_filter.oracle(), "op11_lexical_search": lexical.oracle(), "op12_manifest": manifest.oracle(), "op13_topk": bitslice.oracle()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
