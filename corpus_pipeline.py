"""The corpus pipeline: five stages from raw documents to a mixed training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontaminate, jaccard_join, language_id, mixing, quality_rules
from cadenza.llm.common import small_batches, stored, unstored

# Every stage takes awkward rows as its operator does, gives an empty table for an empty one, and all but the last return the columns of ``docs`` as they are, whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep.

    Null, empty and short texts go; a null source is a host of its own; repeated rows are
    judged alike and all stay or go.
    """
    small_batches(spark)
    return quality_rules.kept_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their labels teach.

    Null text and text without letters go, as does everything if no row has a language;
    rows whose own language is null are judged like others, repeated rows alike.
    """
    small_batches(spark)
    return language_id.kept_documents(docs, language_id.learn(docs, judged=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least by id, of each group that links connect.

    Of exact and near copies one stays, whether or not they share an id; rows without
    words link with nothing and stay; a null id comes after all others.
    """
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Rows without words stay; an item without words takes nothing away, one whose id is
    null does; repeated rows are judged alike.
    """
    small_batches(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; ``copy``, a column more, numbers the repeats.

    A null source is a source of its own; rows without words are taken as their hash says,
    as they change no sum; ties are broken by the text.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("source mixing", mixture),
]

#: Cross-parsing and transitive links have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``; what a stage keeps is written before the next reads it, and removed when that is written.

    An empty table of documents gives no rows, with the columns of the last stage.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            unstored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
