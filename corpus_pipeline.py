"""Documents to token ids: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import mixing, near_dup, pieces, pii, quality
from tidewatch.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or an adaptive threshold rejects go."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a similarity of 0.8 or more) stays: the one with the smallest doc_id."""
    return near_dup.deduplicated(docs, percent=near_dup.CORPUS_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    return pii.redacted_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to target weights; a document taken in two epochs comes twice."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and piece_ids of each text, with the text that they decode to."""
    texts = docs.select("doc_id", "lang", "source", "text")
    return pieces.encoded_documents(texts, public_tokenizers.path("piece_bpe_32k.model"), with_decoded=True).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mixing_sources),
    ("encoding", encoding),
]

#: SQL can't express the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
