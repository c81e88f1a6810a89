"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import langid, mixing, neardup, quality, segment
from folioforge.llm.common import stage_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or with too little evidence go."""
    return langid.accepted_documents(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are too frequent in their source."""
    return quality.cleaned_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicated_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document of the mixture: doc_id, source, ids, score, margin."""
    import public_tokenizers

    return segment.encoded_documents(docs, vocabulary=public_tokenizers.path("piece_bpe_32k.model"), keep=("source",))


STAGES = [
    ("language identification", language),
    ("quality rules", rules),
    ("near-duplicate removal", near_duplicates),
    ("mixing to target weights", mixture),
    ("piece encoding", pieces),
]

#: Signatures, hashes and the search over the piece lattice are not SQL; tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what stands between two stages is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
