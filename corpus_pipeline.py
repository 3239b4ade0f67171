"""A training-data pipeline over the documents table: quality rules, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir). Its result is written as Parquet below the
shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe import encode_documents
from sparkloom.llm.common import stash, table
from sparkloom.llm.line_dedup import drop_duplicate_lines
from sparkloom.llm.quality import keep_quality
from sparkloom.llm.simhash import keep_one
from sparkloom.llm.tiling import annotate


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them.

    Repeated rows and ties are judged alike and long texts whole, columns may have any names, and an empty table
    stays empty; this holds for all stages.
    """
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that resemble an earlier one go; null texts stay, and a repeated row loses its long lines."""
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those of a similarity of 0.8 or more are linked. Null and empty texts are one group."""
    return keep_one(docs, similar=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go; null and empty texts hold none."""
    name = "_leaks"
    while name in docs.columns:
        name += "_"
    return annotate(docs, table(spark, sf_dir, "benchmark"), name=name).where(F.size(name) == 0).drop(name)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as token ids: their number, and digests of ids and decoded bytes. A null or empty text has none, and a row."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: Robust estimates, fingerprints and exact merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
