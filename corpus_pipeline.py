"""A training corpus from raw documents: rules, classifier, near-dedup, mixing, packing.

Every stage works on all rows that the stage before it kept. Models are fitted
on the labelled rows of the whole ``documents`` table, bounded as their modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, mixing, near_dedup, packing, quality_classifier, quality_rules


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    model = quality_rules.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_rules.filter_documents(docs, model)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    model = quality_classifier.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_classifier.filter_documents(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its sequence and its place there."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-dedup", dedup), ("mixing", mixture), ("packing", packed)]

#: SQL can express neither the models nor the tokenizer; tests/llm compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each other stage is written as Parquet and reread."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
