"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage works on all that its predecessor kept; stages hand over Parquet
tables in the shared folder of ``spark.checkpoint.dir``, so a lost executor
repeats tasks of one stage only.  All stages but the last return the columns of
``documents``; the last returns the documents as token ids.

Null texts count as empty and are rejected by the quality rules; empty tables
pass through; columns beyond those of ``documents`` are kept by every stage but
the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from ledgerlens.llm import bpe, fm_index, pii, quality, simhash
from ledgerlens.llm.common import table, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lose at most half of their words to the line rules."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    return fm_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; ``n_chars`` follows the new text."""
    return pii.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the texts as token ids."""
    found = bpe.encode(docs, ranks_path, keep=["doc_id", "lang", "source"])
    return found.select("row.*", "n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", privacy_stage),
    ("bpe_tokens", token_stage),
]

# The stages use hashes, a suffix index and a tokenizer that SQL lacks; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
