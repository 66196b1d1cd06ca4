"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.bpe import encode_documents
from cadenza.llm.chat import format_conversations
from cadenza.llm.factorisation import quality_scores
from cadenza.llm.licences import licence_scan
from cadenza.llm.mixing import mix_documents
from cadenza.llm.near_copies import NearCopies, near_copy_components
from cadenza.llm.pages import extract_pages
from cadenza.llm.personal_data import personal_data
from cadenza.llm.quality_rules import quality_rules
from cadenza.llm.vectors import nearest_neighbours


def vocabulary(name: str) -> str:
    """Where the published tokenizer files lie; every machine of the cluster has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_components(_table(spark, sf_dir, "documents"), NearCopies(k=3, percent=90))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    found = format_conversations(rows, vocabulary("byte_bpe_50k.json"))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_quality_classifier, op3_personal_data, op4_ngram_jaccard, op5_source_mix,
        op6_licence_scan, op7_page_text, op8_nearest_vectors, op9_chat_format, op10_bpe,
    )
}
