"""Documents for training: toxic ones out, repeated lines out, near duplicates out, benchmark leaks out, sources mixed.

Every stage takes the documents that its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents; the last adds `taken`, the words that the mix takes of a document, repeats
counted. Null texts, sources and ids are documents like any other, whatever each stage says of them; columns of
any name go through all stages, but for `taken`, which the last replaces. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraft.llm import decontaminate, lines, mixing, shingles, toxicity
from lexgraft.llm.common import dropped, table, written


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, at worst with an empty text; n_chars follows the text."""
    out = lines.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_one(docs, width=5, threshold=0.8)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", civil),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_kind),
    ("decontamination", without_leaks),
    ("mixing", mixed),
]

#: SQL can't express the classifier and the fingerprints; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir), STAGES[0][0])
    for name, stage in STAGES[1:]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs
