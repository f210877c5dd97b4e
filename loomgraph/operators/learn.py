"""Learning from feedback, and lessons from dated outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import relation_importance

# Sources whose records are never learned from.
HELD_OUT = ("benchmark", "eval", "held_out", "crosscodeeval", "ground_truth", "retrieval_eval")


def learned_weights(log: DataFrame, strength: float = 8.0, least: int = 3) -> DataFrame:
    """(relation, exposures, positives, importance, active): the mean of a Beta posterior around each relation's prior, from
    records that aren't held out and have a verdict and relations; a relation counts once a record."""
    used = log.filter("NOT coalesce(held_out, false) AND useful IS NOT NULL AND size(relations) > 0").filter(~F.coalesce(F.col("source"), F.lit("")).isin(*HELD_OUT))
    each = used.select("useful", F.explode(F.array_distinct("relations")).alias("relation"))
    n = each.groupBy("relation").agg(F.count("*").alias("exposures"), F.sum(F.col("useful").cast("long")).alias("positives"))
    mean = (relation_importance(F.col("relation")) * strength + F.col("positives")) / (strength + F.col("exposures"))
    return n.withColumn("importance", F.least(F.lit(1.0), F.greatest(F.lit(0.05), mean))).withColumn("active", F.col("exposures") >= least)


def lessons(docs: DataFrame, now: str, half_life: float = 30.0, least: int = 2, known: DataFrame | None = None) -> DataFrame:
    """(node, score, positives, negatives, last, status): outcomes of memory documents (date, outcome, source_nodes), useful
    ones +1, others -1, halved each half_life days; contested with both signs, preferred with `least` good ones. known: only nodes with an id in it count."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(now).cast("date"), F.to_date("date")))
    decay = F.pow(F.lit(0.5), F.coalesce(age, F.lit(0)) / F.lit(half_life)) if half_life > 0 else F.lit(1.0)
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome").isin("dead_end", "corrected"), -1)
    each = docs.select("date", sign.alias("sign"), decay.alias("decay"), F.explode(F.array_distinct("source_nodes")).alias("node")).filter("sign IS NOT NULL")
    if known is not None:
        each = each.join(known.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    out = each.groupBy("node").agg(
        F.round(F.sum(F.col("sign") * F.col("decay")), 9).alias("score"), F.sum((F.col("sign") > 0).cast("long")).alias("positives"), F.sum((F.col("sign") < 0).cast("long")).alias("negatives"), F.max("date").alias("last")
    )
    status = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), "contested").when(F.col("negatives") > 0, "avoid").when(F.col("positives") >= least, "preferred").otherwise("tentative")
    return out.withColumn("status", status)


def latest(docs: DataFrame) -> DataFrame:
    """The last document of each question, by date and then id."""
    return docs.groupBy("question").agg(F.max(F.struct("date", "event_id", "outcome")).alias("x")).select("question", "x.date", "x.event_id", "x.outcome")
