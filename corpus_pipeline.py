"""From raw documents to training tokens: five stages, each of which reads what its predecessor kept.

All stages take null texts for empty ones, pass rows that repeat or have no id through like any others unless their text
says otherwise, keep columns of any name but for the last stage, and give an empty table for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import bpe, exact_dedup, mixing, quality, shingles
from chronotext.llm.shared import free, remainder, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.5); it is learnt from the labels of rows that are not held out.

    Null and empty texts are judged like any other; without labels of both kinds the base rate decides on all.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    score, predicted = free(docs.columns, "_score", "_predicted")
    return quality.score(docs, model, score=score, predicted=predicted).filter(F.col(predicted) == 1).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (null is empty): the one with the largest doc_id; one without an id only where no other has the text."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity >= 0.8): the one with the smallest doc_id.

    Blank texts are near copies of each other; documents without an id stay.
    """
    return shingles.dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, drawn by the quality that the classifier gives each document; a document is a row as often as the mix takes it."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    score, predicted = free(docs.columns, "_score", "_predicted")
    return mixing.mixed(quality.score(docs, model, score=score, predicted=predicted), weight=mixing.quality_weight(F.col(score)), keep=docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to the text again; an empty or null text has none."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.transcode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "source", "lang"])
    return rows.select("doc_id", "source", "lang", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("shingle near-dedup", near_stage), ("mixing", mix_stage), ("byte-level bpe", bpe_stage)]
#: SQL can't express the classifier, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
