"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import bytebpe, chat, fingerprint, html_text, lines, media, packing, quality, substrings, toxicity
from undertow.llm.common import table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.expand(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op5_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = bytebpe.ByteBPE(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytebpe.encode_decode(table(spark, sf_dir, "documents"), how, digests=True)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint.hex_digits("fp").alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_packing": op2_packing,
    "op3_html": op3_html,
    "op4_chat": op4_chat,
    "op5_bytebpe": op5_bytebpe,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_substrings": op8_substrings,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op1_lines": lines.LINE_SQL}
