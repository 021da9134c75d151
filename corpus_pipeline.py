"""From raw documents to packed training sequences, in five stages; each is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import exact_dedup, jaccard_join, packing, quality, source_mix
from cartolith.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null texts are scored as empty ones; rows with null or
    repeated ids are judged by their own text; extra columns pass through; an empty table gives none."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, null ids last, and one of rows that are the same. Null texts are
    equal to empty ones; extra columns pass through; an empty table gives none."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-copy links the one with the smallest id, null ids last, and one of rows that are the
    same. Texts without words link with nothing and stay; extra columns pass through; an empty table gives none."""
    return jaccard_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a schedule, file by file. Target weights: square roots of the sources' counts. A null
    source is a source; rows with one id, or none, stay together; extra columns pass through; an empty table gives none."""
    return source_mix.in_mixed_order(docs, power=0.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 4096 tokens; files, runs of the mixture, are packed one by one in their rows' order. Rows that
    come from no file are packed in seeded order. Null texts are one id, null and repeated ids keep their rows, extra
    columns are not read, an empty table gives none."""
    tokenizer = packing.read_tokenizer(packing.tokenizer_path())
    if docs.inputFiles():
        return packing.pack_sequences(docs, tokenizer, run=F.col("_metadata.file_path"), at=F.col("_metadata.row_index"))
    return packing.pack_sequences(docs, tokenizer)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The learned scores and the tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
