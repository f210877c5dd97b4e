"""The operators applied to whole tables, and SQL for the results that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, htmlcut, idcoder, jaccard, mixing, quality, repetition, sharding, tokens, urlfilter
from .common import table


def op1_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(table(spark, d, "documents"), 40)


def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"))


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(table(spark, d, "documents"))


def op5_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return idcoder.read_ids(idcoder.write_ids(table(spark, d, "documents"), whole_texts=True))


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urlfilter.verdicts(urlfilter.sample_captures(table(spark, d, "pages")), urlfilter.sample_entries(spark))


def op7_html_text(spark: SparkSession, d: str) -> DataFrame:
    return htmlcut.extract(table(spark, d, "pages"))


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, d, "documents"))


def op10_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.judge(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_mixing, op4_token_counts, op5_token_ids, op6_url_filter, op7_html_text, op8_quality, op9_jaccard_join, op10_repetition)}
ORACLE = {"op3_mixing": mixing.mixed_sql(), "op6_url_filter": urlfilter.SQL}
