"""From documents to a training corpus: quality, near copies, benchmark leaks, mixing, token ids.

All stages take null, empty and very long texts, null and repeated ids, repeated rows, other columns and empty tables, as their
operators' docstrings say. All but the last return the columns they got, each row at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontamination, idcoder, jaccard, mixing, quality
from loomgraph.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts have the share of good labels as their score."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id, nulls last; texts without words are alike if equal."""
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is leaked; null and empty texts hold none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words over the target shares of sources, languages and topics; null ids and empty cells stay."""
    return mixing.mix(docs, whole=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the corpus, written, read back and summed up by document; null and empty texts have the end id only."""
    return idcoder.read_ids(idcoder.write_ids(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixing_sources),
    ("token-id output", token_ids),
]

#: The classifier, the join and the coder are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written as Parquet to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
