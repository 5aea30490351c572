"""A corpus pipeline: language, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet to the shared folder and
reads them again as the next one's docs. All stages but the last return the columns of documents.

Defined cases, in every stage: rows with a null id, and rows with equal ids, are rows of their own; extra columns, whatever their names, are carried along up to packing, which
returns its own; an empty table stays empty; very long texts are handled whole. Null, empty and letterless texts have no language, so the first stage drops them; ties in a stage are
decided as its operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm import langid, mixing, neardup, packing, pii
from lumenvec.llm.common import dropped, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; a null text, one without letters, and one whose best languages are too close are rejected."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: word shingles of five, similarity of 0.8 or more. That is the one with the smallest id, or one of a group without ids."""
    return neardup.deduplicated(docs, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts becomes the name of its kind, and n_chars follows. A null text stays null."""
    return docs.withColumn("text", pii.redacted(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mixture takes them: not at all, once or twice. A null source is a source."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]
#: Compression, trees and balanced sampling have no SQL; tests/llm/test_pipeline.py holds each stage against its brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)  # the stage that read it is written
        before = docs
    return docs
