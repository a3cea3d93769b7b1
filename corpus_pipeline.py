"""The corpus pipeline: STAGES of (name, function), each (spark, docs, sf_dir) -> DataFrame.

All stages but the last keep the columns of `docs`, whatever their names, and give an empty
table for an empty one. Null texts count as empty for the classifier and the packing, and
pass the other stages unchanged, as rows with a null doc_id pass the two that cut texts.
Repeated rows are scored and packed each; of near duplicates, which they are, one stays.
n_chars, where there is one, is counted again after a text was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.jaccard_join import near_duplicates_removed
from marlstone.llm.line_dedup import passages_removed
from marlstone.llm.names import fresh
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality import quality_filtered
from marlstone.llm.substring_dedup import substring_dedup
from marlstone.plans.materialize import discard, scratch, written
from marlstone.session import ship, table


def _measured(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of `before`, with n_chars counted again where it is a column."""
    columns = [F.coalesce(F.char_length("text"), F.lit(0)).cast(before.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
               for c in before.columns]
    return after.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality_filtered(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut runs of two lines or more that occurred before; no document goes."""
    ship(spark)
    return _measured(docs, passages_removed(docs, count_col=fresh(docs.columns, "n_removed")[0]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    ship(spark)
    return near_duplicates_removed(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that occurred before; no document goes."""
    ship(spark)
    return _measured(docs, substring_dedup(docs, count_col=fresh(docs.columns, "cut_chars")[0]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, one row per piece."""
    ship(spark)
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", substrings), ("best-fit packing", pack)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # what a stage wrote on its way goes once its output is there
            after = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
