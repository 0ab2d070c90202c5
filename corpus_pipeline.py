"""From raw documents to a mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import decontaminate, exact, mixing, quality, shingles
from corpuslab.llm.common import saved, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it is fitted on labelled rows of the documents at hand."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity of five-word shingles, 0.8 or more, connects, the smallest id stays."""
    return shingles.keep_one_per_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its error budget, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document that is left; a document of which none are taken has zero."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: The classifier and the fingerprints have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``: ``doc_id, size, source_size, target, taken`` of the documents that all stages keep.

    Nulls in any column, empty and very long texts, repeated rows and extra columns pass through as the stages
    define; an empty table gives an empty mix.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
