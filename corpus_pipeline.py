"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, suffix-array dedup, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet in the shared folder and
read again as the next stage's ``docs``; so a lost executor costs the running stage alone.  All stages
but the last return the columns of ``documents``; stages define null, empty and repeated rows as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import materialize
from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import quality_filter
from corpusloom.llm.simhash import near_dedup
from corpusloom.llm.suffix_dedup import suffix_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest, then the one with the smallest id."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id.

    Near copies share four fifths of their five-word shingles; fingerprints of such documents differ in few bits, and the
    texts of linked fingerprints are compared before a document goes.
    """
    return near_dedup(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that a document with a smaller id also holds."""
    return suffix_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("suffix_dedup", suffix_stage), ("packing", packing_stage)]

#: Fingerprints, repeated passages and packing are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
