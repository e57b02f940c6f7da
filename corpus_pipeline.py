"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

The first four stages return the columns of documents; the last one returns the mixture, a row for each document and
epoch it is drawn in.

Defined results, in every stage: null texts are empty texts; rows with a null doc_id are judged for quality, lose
repeated lines and otherwise pass; rows that repeat a doc_id share its fate and are each kept or dropped; documents of
equal rank are told apart by doc_id; an empty table gives an empty result; other columns are ignored. Empty texts are
in no mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tessera.llm._common import read, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRY = COLUMNS[2:]
#: Documents that score less go.
QUALITY = 0.3
#: More contaminated documents than this aren't sent to every task.
MOST_SENT = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality.score_quality(docs, read(spark, sf_dir, "labels"), carry=CARRY)
    return scored.where(F.col("score") >= QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one document only."""
    found = line_dedup.drop_repeated_lines(docs, carry=CARRY)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find_benchmark(docs, read(spark, sf_dir, "benchmark"))
    found = written(found.where("doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct(), "contaminated")
    gone = F.broadcast(found) if found.count() <= MOST_SENT else found
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, with the documents' other columns."""
    return mixing.mixed(docs, carry=("text", "lang", "n_chars"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("mixing", mixing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents, each one's rows written before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
