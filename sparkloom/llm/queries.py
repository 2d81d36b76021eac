"""The subpackage's queries: each applies one operator, with production settings, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import conversations, filter_audit, langid, licenses, mixing, nbsvm, quality_rules, rabitq, sentencepiece_codec, simhash, suffix_dedup, token_counts, warc
from sparkloom.session import table


def tokenizer_bytes(name: str = "piece_bpe_32k.model", folder: str | None = None) -> bytes:
    """A public tokenizer's file, read on the driver and sent along with the tasks. folder: where the files lie."""
    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path(name))
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_bytes())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "kept_text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "source")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_bytes("word_bpe_49k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_warc,
        op3_language_id,
        op4_simhash,
        op5_quality_classifier,
        op6_sentencepiece,
        op7_license_scan,
        op8_embedding_near_dedup,
        op9_suffix_array,
        op10_mixing,
        op11_token_counts,
        op12_conversation_repair,
        op13_filter_audit,
    )
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_warc": warc.SQL,
    "op7_license_scan": licenses.sql(),
    "op12_conversation_repair": conversations.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
