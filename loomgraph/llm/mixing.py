"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells (source, language, topic). The words of the cells are raked in turn to the target shares of
sources, languages and topics; a document stays with the probability of its cell, decided by a hash of its id.

Cells are few however many documents there are, and they carry sums. The raking is a chain of window sums over the cell
table, each within a value of a dimension; up to LOCAL_CELLS cells it runs in one partition, so that the chain needs no
shuffle. Totals over all cells are one-row aggregates.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

SWEEPS = 12
TEMPER = 0.9
SEED = "mix-1"
LOCAL_CELLS = 10_000
#: How far a raked share may be from its target before a warning is given.
MISS = 0.01
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column, words: Column) -> Column:
    """A stand-in for a topic, from the form of the text, as these tables have none; pass another column where there is a better one."""
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    low = F.lower(text)
    return (
        F.when(words < 60, "brief")
        .when(pipes * 5 > words, "table")
        .when(F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright")), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(words >= 1000, "long")
        .otherwise("prose")
    )


def named(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("(none)"))


def features(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic and words of each row. Null sources and languages are a category of their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", named("source").alias("source"), named("lang").alias("lang"), text.alias("text"), n_words(text).alias("words"))
    return out.select("doc_id", "source", "lang", (topic_of(F.col("text"), F.col("words")) if topic is None else topic).alias("topic"), "words")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, temper: float = TEMPER, whole: bool = False) -> DataFrame:
    """cells (source, lang, topic, words) with `weight` raked to the targets, `factor` = weight / words and `p`.

    targets: shares for values of a dimension, those not named sharing what is left as they do now; a dimension without
    targets gets its present shares to the power `temper`, scaled to 1. Cells without words weigh nothing and have p = 1.
    whole: p is the factor, at most 1, so that a cell gives up only its words over its target, whatever the others need. Else
    p is the factor over the largest one, as in `mixed_sql`, and the cell with the largest factor sets the size of the result.
    """
    for d, given in (targets or {}).items():
        if d not in DIMENSIONS or sum(given.values()) > 1 + 1e-9 or min(given.values(), default=0) < 0:
            raise ValueError(f"targets of {d} aren't shares of a dimension")
    out = with_total(cells.withColumn("weight", F.col("words").cast("double")), "total", F.sum("words"))
    for d in DIMENSIONS:
        now = F.sum("weight").over(Window.partitionBy(d)) / F.col("total")
        if given := (targets or {}).get(d):
            goal = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(d)]
            out = out.withColumn("now", now).withColumn("goal", goal)
            out = with_total(out, "rest", F.sum(F.when(F.col("goal").isNull(), F.col("weight"))) / F.max("total"))
            out = out.withColumn(f"to_{d}", F.coalesce("goal", F.col("now") * (1 - sum(given.values())) / F.col("rest"))).drop("now", "goal", "rest")
        else:  # each cell carries its part of its value's share, so that shares add up over cells
            part = F.when(F.sum("weight").over(Window.partitionBy(d)) > 0, F.col("weight") / F.sum("weight").over(Window.partitionBy(d))).otherwise(0.0)
            out = with_total(out.withColumn("raised", F.pow(now, F.lit(temper))).withColumn("part", part), "all_raised", F.sum(F.col("raised") * F.col("part")))
            out = out.withColumn(f"to_{d}", F.col("raised") / F.col("all_raised")).drop("raised", "part", "all_raised")
    for _ in range(sweeps):
        for d in DIMENSIONS:
            share = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(share > 0, F.col("weight") * F.col(f"to_{d}") * F.col("total") / share).otherwise(0.0))
    out = out.withColumn("factor", F.when(F.col("words") > 0, F.col("weight") / F.col("words")))
    out = materialise(out.select(*DIMENSIONS, "words", "weight", "factor", *[f"to_{d}" for d in DIMENSIONS]), "mix-weights")
    p = F.least("factor", F.lit(1.0)) if whole else F.col("factor") / F.col("most")
    return with_total(out, "most", F.max("factor")).withColumn("p", F.coalesce(p, F.lit(1.0))).drop("most")


def with_total(df: DataFrame, name: str, total: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(total.alias(name))))  # one row


def misses(raked: DataFrame, targets: dict[str, dict[str, float]] | None = None, most: float = MISS) -> list[tuple[str, str, float, float]]:
    """(dimension, value, target, share of the raked weights) where they differ by over `most`: shares that the cells can't
    meet together, or that need more sweeps; at most 20 for each dimension. A target for a value without cells is one too."""
    out = []
    for d in DIMENSIONS:
        shares = with_total(raked.groupBy(d).agg(F.sum("weight").alias("w"), F.max(f"to_{d}").alias("goal")), "all", F.sum("w"))
        gap = F.abs(F.col("w") / F.col("all") - F.col("goal"))
        out += [(d, r[d], r["goal"], r["w"] / r["all"]) for r in shares.filter(gap > most).orderBy(gap.desc(), d).limit(20).collect()]
        if given := (targets or {}).get(d):
            found = {r[0] for r in raked.filter(F.col(d).isin(list(given)) & (F.col("words") > 0)).select(d).distinct().collect()}
            out += [(d, v, x, 0.0) for v, x in given.items() if v not in found and x > most]
    return out


def cell_rates(seen: DataFrame, targets=None, sweeps: int = SWEEPS, temper: float = TEMPER, whole: bool = False) -> DataFrame:
    cells = materialise(seen.groupBy(*DIMENSIONS).agg(F.sum("words").alias("words")), "mix-cells")
    if cells.count() <= LOCAL_CELLS:
        cells = cells.coalesce(1)
    raked = materialise(rake(cells, targets, sweeps, temper, whole), "mix-rates")
    if missed := misses(raked, targets):
        warnings.warn(f"target shares that raking has not met: {missed}", stacklevel=3)
    return raked


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat(doc_id.cast("string"), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_rates(rows: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Cells up to LOCAL_CELLS are sent to all tasks; beyond that Spark joins by key and splits large partitions."""
    rates = rates.select(*[F.col(d).alias(k) for d, k in zip(DIMENSIONS, keys)], F.col("p").alias("__p"))
    return rows.join(F.broadcast(rates) if rates.count() <= LOCAL_CELLS else rates, keys)


def mixed(docs: DataFrame, targets=None, sweeps: int = SWEEPS, temper: float = TEMPER, seed: str = SEED) -> DataFrame:
    """doc_id, source, lang, topic, n_words, p and kept for each row of docs (doc_id, text, source, lang).

    Rows with a null id stay, as chance decides by id; repeated rows share their fate; an empty
    table gives an empty result. Null and empty texts carry no weight: they follow their cell, or stay if it has no words. Long
    texts count whole; other columns are not looked at.
    """
    seen = materialise(features(docs), "mix-rows")
    out = with_rates(seen, cell_rates(seen, targets, sweeps, temper), list(DIMENSIONS))
    kept = F.coalesce(chance(F.col("doc_id"), seed) < F.col("__p"), F.lit(True))
    return out.select("doc_id", *DIMENSIONS, F.col("words").alias("n_words"), F.round("__p", 6).alias("p"), kept.alias("kept"))


def mix(docs: DataFrame, targets=None, sweeps: int = SWEEPS, temper: float = TEMPER, seed: str = SEED, whole: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns; each once at most, so that ids stay unique. Odd rows are treated as
    in `mixed`."""
    rates = cell_rates(features(docs), targets, sweeps, temper, whole)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = ["__source", "__lang", "__topic"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named("source").alias("__source"), named("lang").alias("__lang"), topic_of(text, n_words(text)).alias("__topic"))
    out = with_rates(rows, rates, keys)
    return out.filter(F.coalesce(chance(F.col("row.doc_id"), seed) < F.col("__p"), F.lit(True))).select("row.*")


def mixed_sql(sweeps: int = SWEEPS, temper: float = TEMPER, seed: str = SEED) -> str:
    """What `mixed` returns for `documents` without given targets, in DuckDB's SQL."""
    steps = [
        f"""seen AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM documents)""",
        """feats AS (SELECT doc_id, source, lang, words, CASE WHEN words < 60 THEN 'brief' WHEN (length(t) - length(replace(t, '|', ''))) * 5 > words THEN 'table'
        WHEN contains(lower(t), 'license') OR contains(lower(t), 'copyright') THEN 'legal' WHEN contains(t, '@') THEN 'contact' WHEN words >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM seen)""",
        "c0 AS (SELECT source, lang, topic, sum(words)::DOUBLE AS words, sum(words)::DOUBLE AS weight FROM feats GROUP BY ALL)",
        "tot AS (SELECT sum(words) AS total FROM c0)",
    ]
    for d in DIMENSIONS:
        steps.append(f"r_{d} AS (SELECT {d}, pow(sum(words) / (SELECT total FROM tot), {temper}) AS r, sum(words) AS w FROM c0 GROUP BY {d})")
        steps.append(f"t_{d} AS (SELECT {d}, r / (SELECT sum(r) FROM r_{d} WHERE w > 0) AS goal FROM r_{d})")
    n = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.words, CASE WHEN sum(weight) OVER (PARTITION BY c.{d}) > 0 THEN weight * goal * (SELECT total FROM tot) / sum(weight) OVER (PARTITION BY c.{d}) ELSE 0 END AS weight FROM c{n} c JOIN t_{d} t ON c.{d} = t.{d})")
            n += 1
    steps.append(f"rates AS (SELECT source, lang, topic, CASE WHEN words > 0 THEN weight / words END AS factor FROM c{n})")
    steps.append("ps AS (SELECT source, lang, topic, coalesce(factor / (SELECT max(factor) FROM rates), 1.0) AS p FROM rates)")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT doc_id, source, lang, topic, words::BIGINT AS n_words, round(p, 6) AS p,
    coalesce(('0x' || substr(md5(doc_id::VARCHAR || ':{seed}'), 1, 8))::BIGINT / 4294967296.0 < p, true) AS kept
    FROM feats JOIN ps USING (source, lang, topic)"""
