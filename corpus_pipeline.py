"""A training corpus from raw documents: filter, clean, deduplicate, decontaminate and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapix.llm import decontaminate, line_dedup, near_dups, packing, quality, tokens
from terrapix.llm.scratch import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more)."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return quality.score_quality(docs, model, score_col="quality_score").where("quality_score >= 0.3").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds too."""
    return line_dedup.drop_shared_lines(docs, min_docs=2, min_chars=10).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of exact or near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dups.drop_near_duplicates(docs, shingle=5, min_similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, *tokens.public_byte_bpe(), capacity=2048, end_id=0, with_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written to the shared folder and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
