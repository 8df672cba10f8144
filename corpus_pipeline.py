"""The corpus pipeline: toxicity, quality rules, n-gram Jaccard join, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import drop_stored, store, table
from loomspark.llm.decontamination import clean
from loomspark.llm.ngram_join import near_duplicates
from loomspark.llm.packing import packing
from loomspark.llm.quality_rules import quality_rules
from loomspark.llm.queries import training_labels
from loomspark.llm.toxicity import toxicity


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; labels of held-out rows are not learned from.

    Null and empty texts are not toxic; repeated rows are judged alike, and all columns stay.
    """
    return toxicity(docs, training_labels(spark, sf_dir)).filter("predicted = 0").select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are too short and go."""
    return quality_rules(docs).filter("quality.kept").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; texts without words are in none."""
    return near_duplicates(docs).select(docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; items without words, and an empty benchmark, remove nothing."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences; of an empty table none."""
    return packing(docs)


STAGES = [("toxicity", not_toxic), ("quality rules", good_quality), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", no_benchmark), ("packing", packed)]

#: The toxicity stage trains a network, which SQL can't express; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep of documents; each stage's rows are written and read again, and deleted when the next has read them."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if held is not None:
            drop_stored(spark, held)
        held = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    # Packing has written its own rows by now.
    drop_stored(spark, docs)
    return out
