"""The corpus pipeline: toxicity, exact copies, near copies, mixing, packing, each over all that the one before keeps.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import exact, minhash, mixing, queries
from quernstone.llm import toxicity as classifier
from quernstone.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold, each row judged by its own text, with or without an id; null texts
    count as empty and stay, as does everything the classifier finds clean."""
    return classifier.drop_toxic(docs, queries.learned_from(table(spark, sf_dir, "labels")), queries.TOXIC)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest id; null and empty texts are one group, rows repeated whole
    are one row."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of similar documents; those without words or id stay."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times; those without words go, as they add none. Rows without
    a source are a source."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a document taken twice is there twice."""
    return queries.packed(docs)


STAGES = [("toxicity", toxicity), ("exact", exact_copies), ("near", near_copies), ("mix", mix), ("pack", pack)]
#: The classifier and the packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
