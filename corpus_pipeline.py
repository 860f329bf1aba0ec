"""The corpus pipeline: quality, line dedup, near-duplicate documents, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``, and no others that the table may have.  A stage's result is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import line_dedup, mixing, ngram_join, packing, quality
from granary.llm._core import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of the documents given."""
    return quality.keep_good(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; one that loses all its lines goes.  n_chars follows the text."""
    out = line_dedup.line_dedup(docs.select(COLUMNS))
    emptied = (F.col("n_dropped") > 0) & (F.regexp_replace("text", r"[\x20\x09-\x0D]", "") == "")
    out = out.where(~emptied).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and again those that the target weights repeat."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bin."""
    return packing.pack(docs.select(COLUMNS))


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("line_dedup", drop_copied_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("temperature_mixing", mix_sources),
    ("best_fit_packing", pack_documents),
]

#: No SQL: a trained classifier, MinHash, hash permutations and a sequential packing; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
