"""A corpus pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Each stage is (name, function of (spark, docs, sf_dir)) and works on all rows that its
predecessor kept: documents predicted toxic go; of linked near copies one stays; secrets are
masked in place; sources are mixed to their targets, so that a document may come up to twice or
not at all; the rest is encoded. All but the last return the columns of documents.

Null texts are kept by the first three stages and count as empty; of rows equal in doc_id and text one stays in the
second. Null sources are one source. Where several documents of a group could stay, the least doc_id does. An empty
table gives an empty result, and further columns are carried to the last stage whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.llm import bpe, jaccard, mixing, secrets, toxicity
from glyphvein.llm.common import released, stored, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    own = {c: unused(docs, c) for c in docs.columns if c in toxicity.COLUMNS}  # names that scores take
    kept = toxicity.score(docs.withColumnsRenamed(own), chain).where(~F.col("rejected")).drop(*toxicity.COLUMNS)
    return kept.withColumnsRenamed({new: c for c, new in own.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("secret_scans", mask_secrets), ("source_mixing", mix_sources), ("byte_level_bpe", encode)]

#: Trained models and similarity joins have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
