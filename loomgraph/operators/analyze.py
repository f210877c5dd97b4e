"""Analyses: surprising connections, bridges, suggested questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .graph import degrees, is_concept_node, is_file_node

PLAIN = ("imports", "imports_from", "contains", "method")


# The language of each file ending, as surprise tells languages apart.
LANGUAGE_OF = {
    "py": "python", "pyw": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ejs": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "vue": "js", "svelte": "js",
    "go": "go", "rs": "rust", "java": "jvm", "kt": "jvm", "kts": "jvm", "scala": "jvm", "c": "c", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c",
    "rb": "ruby", "rake": "ruby", "swift": "swift", "cs": "dotnet", "php": "php", "r": "r",
}


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def category(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("py", "js", "ts", "java", "go", "rs", "c", "cpp", "cs", "rb", "kt", "scala", "php", "swift", "sql", "sh"), "code").when(end == "pdf", "paper").when(end.isin("png", "jpg", "jpeg", "gif", "svg", "webp"), "image").otherwise("doc")


def surprises(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence, score) of edges between files, file and concept nodes left out, by additive points: confidence, kind of file, top
    folder, community, and a quiet node beside a busy one; none of them for inferred calls and uses across languages or
    between code and prose."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("label").alias(f"{p}_label"), F.col("source_file").alias(f"{p}_file"), F.col("community").alias(f"{p}_community"))
    degree = materialise(degrees(edges), "degrees")
    deg = lambda p: degree.select(F.col("id").alias(f"{p}_deg_id"), F.col("degree").alias(f"{p}_degree"))
    e = edges.filter(~F.col("relation").isin(*PLAIN)).join(side("s"), F.col("src") == F.col("s_id")).join(side("t"), F.col("dst") == F.col("t_id")).filter("s_file <> t_file AND s_file <> '' AND t_file <> ''")
    e = e.join(deg("s"), F.col("src") == F.col("s_deg_id")).join(deg("t"), F.col("dst") == F.col("t_deg_id"))
    for p in ("s", "t"):
        e = e.filter(~is_concept_node(F.col(f"{p}_file")) & ~is_file_node(F.col(f"{p}_label"), F.col(f"{p}_file"), F.col(f"{p}_degree")))
    ca, cb = category(F.col("s_file")), category(F.col("t_file"))
    across = F.coalesce(language(F.col("s_file")) != language(F.col("t_file")), F.lit(False)) | ((ca == "code") & (cb == "doc")) | ((ca == "doc") & (cb == "code"))
    weak = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & across
    top = lambda c: F.substring_index(c, "/", 1)
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    points = F.when(weak, 0).otherwise(base + F.when(ca != cb, 2).otherwise(0) + F.when(top("s_file") != top("t_file"), 2).otherwise(0) + F.when(F.col("s_community") != F.col("t_community"), 1).otherwise(0))
    points = F.when(F.col("relation") == "semantically_similar_to", F.floor(points * 1.5)).otherwise(points)
    quiet = (F.least("s_degree", "t_degree") <= 2) & (F.greatest("s_degree", "t_degree") >= 5)
    return e.select("src", "dst", "relation", "confidence", (points + F.when(quiet, 1).otherwise(0)).cast("long").alias("score"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(c1, c2, src, dst, relation): one edge for each pair of communities, the least sure first, then by its ends."""
    c = nodes.select("id", "community")
    e = edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").filter("a <> b")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    best = e.groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.min(F.struct(rank.alias("r"), "src", "dst", "relation")).alias("x"))
    return best.select("c1", "c2", "x.src", "x.dst", "x.relation")


def questions(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(kind, subject, question): ambiguous edges, busy nodes with two or more inferred edges, isolated nodes."""
    label = nodes.select("id", "label")
    doubt = edges.filter("confidence = 'AMBIGUOUS'").join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    doubt = doubt.orderBy("src", "dst", "relation").limit(top).select(F.lit("ambiguous_edge").alias("kind"), F.col("src").alias("subject"), F.format_string("What is the exact relation of `%s` and `%s`?", "a", "b").alias("question"))
    busy = degrees(edges).orderBy(F.desc("degree"), "id").limit(top)
    ends = edges.filter("confidence = 'INFERRED'").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n >= 2")
    inferred = busy.join(ends, "id").join(label, "id").select(F.lit("inferred_hub").alias("kind"), F.col("id").alias("subject"), F.format_string("Are the %d inferred relations of `%s` right?", "n", "label").alias("question"))
    alone = nodes.join(degrees(edges), "id", "left_anti").orderBy("id").limit(top).select(F.lit("isolated").alias("kind"), F.col("id").alias("subject"), F.format_string("What connects `%s` to the rest?", "label").alias("question"))
    return doubt.union(inferred).union(alone)
