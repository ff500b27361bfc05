"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import bpe, chat, fm_index, html, lm, paragraphs, phrases, pii, quality, reversed_search, ring, simhash, warc
from ledgerlens.llm.common import table
from ledgerlens.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents")).drop("found")


def op2_ring(spark: SparkSession, folder: str) -> DataFrame:
    found = ring.assign(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolve(warc.captures_of(table(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.withColumn("headers", F.when(F.col("headers").isNotNull(), F.concat_ws(";", lines)))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode(table(spark, folder, "documents"), corpus_pipeline.RANKS, keep=["doc_id"], outputs="digests")
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_fm_index(spark: SparkSession, folder: str) -> DataFrame:
    found = fm_index.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op8_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    found = html.main_text(table(spark, folder, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    found = paragraphs.repeats(table(spark, folder, "documents"))
    places = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))
    chars = F.aggregate("spans", F.lit(0), lambda total, s: total + s["stop"] - s["start"]).cast("long")
    return found.select("doc_id", "keeper_doc_id", "kind", "removed", chars.alias("n_chars"), F.concat_ws(",", places).alias("spans"))


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.format_turns(rows))


def op12_reversed_search(spark: SparkSession, folder: str) -> DataFrame:
    return reversed_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_ring": op2_ring,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_fm_index": op5_fm_index,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_lm": op8_lm,
    "op9_html": op9_html,
    "op10_paragraphs": op10_paragraphs,
    "op11_chat": op11_chat,
    "op12_reversed_search": op12_reversed_search,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}
