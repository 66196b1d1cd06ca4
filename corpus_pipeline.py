"""From documents to tokens: quality rules, near copies, personal data, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.bpe import encode_documents
from cadenza.llm.mixing import mixed_rows
from cadenza.llm.near_copies import NearCopies, drop_near_copies
from cadenza.llm.personal_data import redact
from cadenza.llm.quality_rules import kept_rows
from cadenza.llm.queries import vocabulary
from cadenza.plans.lineage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity of 0.8 or more) stays."""
    return drop_near_copies(docs, NearCopies(k=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kinds."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, or repeated, so that the sources come near their targets."""
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens, as a number and digests."""
    return encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("source_mix", source_mix), ("bpe", bpe)]

#: The components of near copies and the tokenizer are beyond SQL on whole tables; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's rows stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
