"""Communities: sizes, cohesion, names, fingerprints, relabelling, scoring and selection, label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .graph import degrees


def internal_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, a, b): distinct unordered pairs of one community that an edge joins."""
    c = nodes.select("id", "community")
    e = edges.filter("src <> dst").join(c.select(F.col("id").alias("src"), F.col("community").alias("c1")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst")
    return e.filter("c1 = c2").select(F.col("c1").alias("community"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, inside, cohesion): joined pairs over possible ones; 1 for a single node."""
    size = nodes.filter("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("size"))
    inside = internal_edges(nodes, edges).groupBy("community").agg(F.count("*").alias("inside"))
    out = size.join(inside, "community", "left").select("community", "size", F.coalesce("inside", F.lit(0)).alias("inside"))
    return out.withColumn("cohesion", F.when(F.col("size") <= 1, 1.0).otherwise(F.col("inside") / (F.col("size") * (F.col("size") - 1) / 2.0)))


def representatives(nodes: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """(community, place, id, label) of the members with the most edges. Each community's best are found by a bounded
    aggregate, not by sorting all members in one task."""
    n = nodes.filter("community IS NOT NULL").join(degrees(edges), "id", "left").select("community", "id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    first = Window.partitionBy("community", "salt").orderBy(F.desc("degree"), "id")
    few = n.withColumn("salt", salt).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top).drop("salt", "place")
    best = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    return few.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top).select("community", F.col("place").cast("long").alias("place"), "id", "label")


def hub_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, label) of the best-connected member."""
    n = nodes.filter("community IS NOT NULL").join(degrees(edges), "id", "left")
    return n.groupBy("community").agg(F.min_by("label", F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "id")).alias("label"))


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(community, signature): 16 hex digits of a SHA-256 over the digests of parts of the sorted members, so that no task
    holds a whole community: members are digested in ranges of 16 bits of their hash."""
    part = F.substring(F.sha2(F.col("id"), 256), 1, 4)
    parts = nodes.filter("community IS NOT NULL").select("community", part.alias("part"), "id").groupBy("community", "part").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("id")), "\n"), 256).alias("h"))
    return parts.groupBy("community").agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256), 1, 16).alias("signature"))


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, n): members that the communities of two partitions (id, community) share."""
    return old.select("id", F.col("community").alias("old")).join(new.select("id", F.col("community").alias("new")), "id").groupBy("old", "new").agg(F.count("*").alias("n"))


def matched(shared: DataFrame) -> DataFrame:
    """(new, old) greedily one to one, largest overlap first, ties to the lesser numbers. Each round takes all pairs that are
    best for both sides, which are those that the greedy order takes next on either side."""
    left = materialise(shared, "overlap")
    taken = None
    while True:
        best = lambda side: Window.partitionBy(side).orderBy(F.desc("n"), "old", "new")
        mutual = left.withColumns({"x": F.row_number().over(best("old")), "y": F.row_number().over(best("new"))}).filter("x = 1 AND y = 1").select("old", "new")
        mutual = materialise(mutual, "matched")
        if not mutual.limit(1).count():
            return taken if taken is not None else shared.select("new", "old").limit(0)
        taken = mutual if taken is None else taken.union(mutual)
        left = materialise(left.join(mutual.select("old"), "old", "left_anti").join(mutual.select("new"), "new", "left_anti").select("old", "new", "n"), "overlap")


def cross_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(c1, c2, n): edges between communities c1 < c2."""
    c = nodes.select("id", "community")
    e = edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    return e.filter("a <> b").groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.count("*").alias("n"))


def scores(nodes: DataFrame, edges: DataFrame, seeds: list[str], terms: list[str]) -> DataFrame:
    """(community, seeds, score): 10 for each seed, 3 for each term in the community's name, 2 for each in a representative,
    1 for each in up to 8 other members, by id."""
    hits = lambda c: sum((F.contains(F.lower(c), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    reps = materialise(representatives(nodes, edges), "reps")
    name = reps.filter("place = 1").select("community", (3 * hits(F.col("label"))).alias("x"))  # the best member names the community
    rep = reps.groupBy("community").agg(F.sum(2 * hits(F.col("label"))).alias("x"))
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    others = nodes.filter("community IS NOT NULL").join(reps.select("id"), "id", "left_anti").withColumn("salt", salt)
    few = others.withColumn("k", F.row_number().over(Window.partitionBy("community", "salt").orderBy("id"))).filter("k <= 8")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("id"))).filter("k <= 8")
    rest = few.groupBy("community").agg(F.sum(hits(F.col("label"))).alias("x"))
    seeded = nodes.filter(F.col("id").isin(*seeds)).groupBy("community").agg(F.count("*").alias("seeds"))
    total = name.union(rep).union(rest).groupBy("community").agg(F.sum("x").alias("x"))
    return total.join(seeded, "community", "left").select("community", F.coalesce("seeds", F.lit(0)).alias("seeds"), (F.col("x") + 10 * F.coalesce("seeds", F.lit(0))).cast("long").alias("score"))


def select(scored: DataFrame, n_seeds: int, least: float = 0.55, most: int = 2) -> tuple[list[int], str, float]:
    """(communities, reason, confidence) from community scores, of which the three best reach the driver."""
    total = scored.count()
    top = scored.orderBy(F.desc("score"), "community").limit(most + 1).collect()
    if not top:
        return [], "no_communities", 0.0
    if not n_seeds:
        return [], "no_seeds", 0.0
    if total == 1:
        return [top[0]["community"]], "single_community", 1.0
    if top[0]["score"] <= 0:
        return [], "no_signal", 0.0
    inside = sum(r["seeds"] for r in top[:most])
    if not inside:
        return [], "seeds_outside", 0.0
    first, second = top[0]["score"], top[1]["score"]
    confidence = first / (first + second) * (0.5 + 0.5 * min(1.0, inside / n_seeds))
    if confidence < least:
        return [], "low_confidence", confidence
    return [r["community"] for r in top[:most] if r["score"] > 0], "selected", confidence


def restrict(nodes: DataFrame, edges: DataFrame, communities: list[int]) -> tuple[DataFrame, DataFrame]:
    """The part of a graph that lies in the given communities."""
    n = nodes.filter(F.col("community").isin(*communities))
    ids = n.select("id")
    e = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return n, e


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, community) after synchronous rounds, a fixed number or until no label changes: each node takes the label that most
    neighbours have, its own counting once, ties to the lesser. Where all labels together come back to what they were before,
    half of the nodes, another one each round, change from then on. Counts of a hub's labels are summed before they meet."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    both = materialise(both.union(loops), "both")
    label = materialise(nodes.select("id", F.col("id").alias("label")), "label")
    seen, halves, r = set(), False, 0
    while rounds is None or r < rounds:
        votes = both.join(label.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("want")).join(label, "id")
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0 if halves else F.lit(True)
        step = materialise(best.select("id", (F.col("want") != F.col("label")).alias("moves"), F.when(turn, F.col("want")).otherwise(F.col("label")).alias("label")), "label")
        label, r = step.select("id", "label"), r + 1
        if rounds is None:
            state = step.agg(F.count_if("moves").alias("n"), F.bit_xor(F.xxhash64("id", "label")).alias("x"), F.bit_xor(F.xxhash64("label", "id")).alias("y")).first()
            if not state["n"]:
                break
            halves = halves or (state["x"], state["y"]) in seen
            seen.add((state["x"], state["y"]))
    return label.select("id", F.col("label").alias("community"))


def louvain(nodes: DataFrame, edges: DataFrame, levels: int | None = None, resolution: float = 1.0) -> DataFrame:
    """(id, community) by modularity: synchronous local moves on DataFrames until no node wants to move, half of the nodes a
    round so that neighbours don't swap, and a smaller part every 12 rounds so that moves made together cannot go on forever;
    then communities become the nodes of the next level, until none merges or for `levels` levels. Names are least members."""
    w = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("w"))
    links = materialise(w.union(w.select("b", "a", "w")), "links")  # symmetric; loops are (a, a, 2 * inner weight)
    total = links.agg(F.sum("w")).first()[0] or 0.0
    merge = lambda df: df.hint("merge")  # noqa: E731  no table of nodes goes to the driver, however small it is: rounds are many
    home = materialise(nodes.select("id", F.col("id").alias("community")), "home")
    if not total:
        return home
    level = 0
    while levels is None or level < levels:
        level += 1
        strength = materialise(links.groupBy("a").agg(F.sum("w").alias("k")), "strength")
        label = materialise(strength.select(F.col("a").alias("id"), F.col("a").alias("c")), "label")
        moved_any, r = False, 0
        while True:
            sums = label.join(merge(strength), F.col("id") == F.col("a")).groupBy("c").agg(F.sum("k").alias("tot"))
            toward = links.filter("a <> b").join(merge(label.select(F.col("id").alias("b"), "c")), "b").groupBy("a", "c").agg(F.sum("w").alias("kin"))
            own = label.select(F.col("id").alias("a"), F.col("c").alias("mine"))
            stay = own.select("a", F.col("mine").alias("c"), F.lit(0.0).alias("kin"))
            options = toward.union(stay).groupBy("a", "c").agg(F.sum("kin").alias("kin")).join(merge(sums), "c").join(merge(strength), "a").join(merge(own), "a")
            rest = F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("kin") - resolution * F.col("k") * rest / total, 9)
            best = options.withColumn("gain", gain).groupBy("a", "mine").agg(F.min_by("c", F.struct((-F.col("gain")).alias("g"), (F.col("c") != F.col("mine")).alias("m"), "c")).alias("new"))
            turn = F.pmod(F.xxhash64("a", F.lit(r)), F.lit(min(64, 2 ** (1 + r // 12)))) == 0  # others each round
            step = materialise(best.select(F.col("a").alias("id"), (F.col("new") != F.col("mine")).alias("wants"), F.when(turn, F.col("new")).otherwise(F.col("mine")).alias("c")), "label")
            label, r = step.select("id", "c"), r + 1
            if not step.filter("wants").limit(1).count():
                break
            moved_any = True
        if not moved_any:
            break
        name = label.groupBy("c").agg(F.min("id").alias("name"))
        label = materialise(label.join(merge(name), "c").select("id", F.col("name").alias("c")), "label")
        home = materialise(home.join(merge(label.withColumnsRenamed({"id": "community", "c": "up"})), "community", "left").select("id", F.coalesce("up", "community").alias("community")), "home")
        up = label.select(F.col("id").alias("a"), F.col("c").alias("ca"))
        links = materialise(links.join(merge(up), "a").join(merge(up.withColumnsRenamed({"a": "b", "ca": "cb"})), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "links")
    return home
