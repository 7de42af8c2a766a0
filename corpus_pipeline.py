"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result to the shared folder before the next, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from foliant.llm.common import checkpoint, fewer_rows_a_batch, table


#: Pre-tokens a worker keeps while packing: fewer than the query alone, since workers hold on to what earlier stages took.
PACKING_KEEPS = 300_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is more likely than not, go."""
    fewer_rows_a_batch(spark)
    return language_id.accepted(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to, or within two edits of, an earlier line go; so do documents left without a word."""
    fewer_rows_a_batch(spark)
    return line_dedup.deduplicated(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the least id stays."""
    fewer_rows_a_batch(spark)
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    fewer_rows_a_batch(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    fewer_rows_a_batch(spark)
    return packing.place(docs, keep=PACKING_KEEPS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

#: The stages learn a model, compare by edit distance and tokenise: SQL cannot say it; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
