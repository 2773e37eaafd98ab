"""The corpus pipeline: each stage works on all that the one before it kept, and reads it from where that wrote it.

quality       rejects texts that fail the rules, and texts made up of lines that too many documents of a host share;
              removes these lines from the other texts, but for the first document that has them
near_dedup    keeps the document with the smallest id of each group at a similarity of 0.8 of five-word shingles
personal_data replaces personal data by its kind
mix           takes each document as often as the target weights of its source ask
tokens        encodes by byte-level BPE and decodes again; the last stage: doc_id, n_tokens, ids and digests
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weighbridge.llm import common, op1_bpe, op2_mix, op3_neardup, op7_quality, op9_personal

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_personal.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return op1_bpe.decode(op1_bpe.encode(docs, path, public_tokenizers.PATTERN), path, digests=True, keep=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: Near-duplicate components, contexts of personal data and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
