"""From raw documents to training ids: quality rules, near-dedup, secret scans, source mix, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of ``documents``, extra ones included, whatever their names. An empty table stays empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlens.llm.bpe_codec import codec_digests
from ctxlens.llm.common import fresh_dir
from ctxlens.llm.near_dedup import keep_one
from ctxlens.llm.quality import kept_rows
from ctxlens.llm.secret_scan import redact_secrets
from ctxlens.llm.source_mix import mixed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: base rules, and cutoffs by language and source, null being a group like any other.

    Null, empty and short texts go by the base rule. Rows are judged one by one, so repeated rows share a verdict.
    """
    return kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id (null last).

    Only linked rows go: rows that share an id, or have none, stay unless their texts are linked. Rows without words are
    linked with nothing and stay.
    """
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the text. A null text becomes empty; no row goes."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, by the sources' weights over time; some are left out, some come twice.

    Null sources are the last source. Documents without words have no share in any source and are left out.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix, in its order: the ids for training, their number and digests, and whether they decode to the text.

    Null texts have no ids. Documents that the mix repeats come as often.
    """
    return codec_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("source_mix", source_mix), ("encode", encode)]

#: SQL has no BPE, no MinHash-independent order of the mix and no decoding of secrets; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = fresh_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
