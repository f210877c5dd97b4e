"""Entity deduplication: exact labels, MinHash bands, guards, Jaro-Winkler, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy, jaro, jaro_winkler, norm_label, numbers_differ, one_edit, shingles, variant_pair
from ..sources.storage import materialise
from .traverse import components

HASHES, BANDS = 126, 14


def exact_groups(docs: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(id, survivor) of all rows whose key others share; the least id survives."""
    g = docs.select(F.col(id_column).alias("id"), key.alias("key"))
    least = g.groupBy("key").agg(F.min("id").alias("survivor"), F.count("*").alias("n")).filter("n > 1")
    return g.join(least, "key").select("id", "survivor")


def min_hashes(text: Column, hashes: int = HASHES) -> Column:
    """MinHash values over the character trigrams of a text without blanks."""
    grams = shingles(F.replace(text, F.lit(" "), F.lit("")), 3)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.array_min(F.transform(grams, lambda g: F.xxhash64(g, i))))


def candidates(labels: DataFrame, bands: int = BANDS, hashes: int = HASHES) -> DataFrame:
    """Pairs (a, b) of labels (label) that share a band, a < b; buckets hold distinct labels, which copies don't swell. The
    hashes of a label are computed once, below the generator of its bands."""
    rows = hashes // bands
    k = labels.select("label", min_hashes(F.col("label"), bands * rows).alias("mins"))
    k = k.select("label", "mins", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    k = k.select("label", "band", F.xxhash64(F.array_join(F.slice("mins", F.col("band") * rows + 1, rows), ",")).alias("key"))
    k = materialise(k, "bands")
    o = k.withColumnRenamed("label", "b")
    return k.withColumnRenamed("label", "a").join(o, ["band", "key"]).filter("a < b").select("a", "b").distinct()


def similar(pairs: DataFrame, least: float = 92.0, boost: float = 5.0) -> DataFrame:
    """(a, b, score) of pairs (a, b, one_file, one_community, anchored) of normalised labels that pass all guards; Jaro where a
    label is long and the files differ, else Jaro-Winkler. Long labels of one community get the boost; anchored labels, of
    documents and rationales, merge within a file only."""
    long = F.greatest(F.length("a"), F.length("b")) >= 12
    p = pairs.filter(~variant_pair(F.col("a"), F.col("b")) & ~numbers_differ(F.col("a"), F.col("b")) & ~F.startswith(F.col("b"), F.concat("a", F.lit(" "))))
    p = p.filter(F.col("one_file") | ~F.col("anchored"))
    p = p.withColumns({"jw": 100 * jaro_winkler("a", "b"), "j": 100 * jaro("a", "b"), "edit": one_edit("a", "b")})
    near = F.col("one_community") & (F.least(F.length("a"), F.length("b")) >= 12)
    p = p.withColumn("score", F.when(long & ~F.col("one_file"), F.col("j")).otherwise(F.col("jw")) + F.when(near, boost).otherwise(0.0))
    return p.filter(F.col("score") >= least).filter(long | ((F.col("jw") >= 97) & F.col("edit"))).select("a", "b", "score")


def dedup_entities(nodes: DataFrame, least_entropy: float = 2.5) -> DataFrame:
    """(id, survivor) for nodes (id, label, file_type, source_file and maybe community), code never merged: one normalised label
    in one file, or in any files if it is a concept's and has the entropy, then similar labels, each by its least node, closed
    over chains. Shortest, then least id survives."""
    if "repo" in nodes.columns and nodes.select("repo").distinct().limit(2).count() > 1:
        raise ValueError("entities of several repositories aren't merged; deduplicate each by itself")
    if "community" not in nodes.columns:
        nodes = nodes.withColumn("community", F.lit(None).cast("int"))
    file = F.coalesce("source_file", F.lit(""))
    n = nodes.filter("file_type <> 'code'").select("id", "file_type", file.alias("source_file"), "community", norm_label(F.col("label")).alias("label")).filter("label <> ''")
    # an entity is a label of a file, or a node without a file; what stands for a label wherever it is begins with a line end
    entity = F.when(F.col("source_file") == "", F.concat(F.lit("\n\n"), "id")).otherwise(F.concat("source_file", F.lit("\n"), "label"))
    keyed = materialise(n.withColumns({"entity": entity, "rich": entropy(F.col("label")) >= least_entropy}), "entities")
    anywhere = keyed.filter("rich AND file_type = 'concept' AND source_file <> ''").select("entity", F.concat(F.lit("\n"), "label").alias("hub")).distinct()
    first = materialise(keyed.filter("rich").groupBy("label").agg(F.min_by(F.struct("entity", "file_type", "source_file", "community"), "id").alias("x")), "labels")
    side = lambda c: first.select(F.col("label").alias(c), F.col("x").alias(f"x{c}"))
    pairs = candidates(first.select("label")).join(side("a"), "a").join(side("b"), "b")
    anchored = F.col("xa.file_type").isin("rationale", "document") | F.col("xb.file_type").isin("rationale", "document")
    pairs = materialise(pairs.select("a", "b", (F.col("xa.source_file") == F.col("xb.source_file")).alias("one_file"), F.coalesce(F.col("xa.community") == F.col("xb.community"), F.lit(False)).alias("one_community"), F.coalesce(anchored, F.lit(False)).alias("anchored")), "pairs")
    found = similar(pairs).join(side("a"), "a").join(side("b"), "b").select(F.col("xa.entity").alias("src"), F.col("xb.entity").alias("dst"))
    links = materialise(found.union(anywhere), "links")
    groups = components(keyed.select(F.col("entity").alias("id")).union(anywhere.select("hub")).distinct(), links)
    g = keyed.join(groups.withColumnRenamed("id", "entity"), "entity").select("id", "component")
    best = g.groupBy("component").agg(F.min_by("id", F.struct(F.rlike("id", F.lit(r"_c\d+$")).alias("x"), F.length("id").alias("n"), "id")).alias("survivor"), F.count("*").alias("n"))
    return g.join(best.filter("n > 1"), "component").select("id", "survivor")


def rewire(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges with merged ends, without the loops that this makes and without repeats."""
    s = survivors.select("id", "survivor")
    e = edges.join(s.withColumnsRenamed({"id": "src", "survivor": "s"}), "src", "left").join(s.withColumnsRenamed({"id": "dst", "survivor": "t"}), "dst", "left")
    return e.withColumns({"src": F.coalesce("s", "src"), "dst": F.coalesce("t", "dst")}).filter("src <> dst").select(*edges.columns).distinct()


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of sets (label, g array<string>) with a Jaccard similarity of at least `threshold`, a < b. Elements are
    ordered by how rare they are; similar sets share one of the first n - ceil(threshold * n) + 1 of theirs, so only these are
    joined, between sets of like sizes; the whole sets decide."""
    e = sets.select("label", F.size("g").alias("n"), F.explode("g").alias("x"))
    often = e.groupBy("x").agg(F.count("*").alias("often"))
    ordered = e.join(often, "x").groupBy("label", "n").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("o"))
    first = ordered.select("label", "n", F.explode(F.slice("o", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)).alias("o")).select("label", "n", F.col("o.x").alias("x"))
    a, b = first.withColumnsRenamed({"label": "a", "n": "na"}), first.withColumnsRenamed({"label": "b", "n": "nb"})
    pairs = a.join(b, "x").filter((F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("label").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("label").alias("b"), F.col("g").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    score = common / (F.size("ga") + F.size("gb") - common)
    return both.select("a", "b", score.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9)
