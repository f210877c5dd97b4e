"""What is shown of a graph: explanations, rankings, excerpts, chunks, reviews of changes, overlays of what was learned."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.weights import relation_importance
from ..sources.storage import materialise
from .graph import degrees, with_importance


def connections(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(place, direction, id, relation, confidence, degree, source_file) of the edges of a node, best-connected neighbours
    first; ties by id, direction and relation. The neighbours of one node only are ranked."""
    out = edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "relation", "confidence")
    both = out.union(edges.filter(F.col("dst") == node).select(F.lit("in"), F.col("src"), "relation", "confidence"))
    seen = both.join(degrees(edges), "id").join(nodes.select("id", "source_file"), "id", "left")
    place = F.row_number().over(Window.orderBy(F.desc("degree"), "id", "direction", "relation", "confidence"))
    return seen.select(place.cast("long").alias("place"), "direction", "id", "relation", "confidence", "degree", "source_file")


def explain(nodes: DataFrame, edges: DataFrame, node: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first `most` connections of a node, and (direction, source_file, n) of up to `most` groups of the others."""
    c = connections(nodes, edges, node)
    rest = c.filter(F.col("place") > most).groupBy("direction", F.coalesce("source_file", F.lit("(unknown file)")).alias("source_file")).agg(F.count("*").alias("n"))
    return c.filter(F.col("place") <= most).drop("source_file"), rest.orderBy(F.desc("n"), "direction", "source_file").limit(most)


def endpoint(scored: DataFrame, query: str) -> DataFrame:
    """(id, label, score): the best of scored (id, label, score) whose label has every word of the query, else the best."""
    words = F.array(*map(F.lit, sorted({w for w in query.lower().split() if w})))
    has = F.size(F.array_except(words, tokens(F.coalesce("label", "id")))) == 0
    return scored.withColumn("has", has).orderBy(F.desc("has"), F.desc("score"), F.length("label"), "id").limit(1).select("id", "label", "score")


def rank_edges(edges: DataFrame, most: int, seq: str = "seq") -> DataFrame:
    """The `most` most important edges; ties in the order in which they were found."""
    return with_importance(edges).orderBy(F.desc("importance"), seq).limit(most)


def rank_by_score(scores: DataFrame, seeds: list[str], most: int = 40) -> DataFrame:
    """(place, id, score): seeds first, in their order, then by score and id; `most` in all."""
    at = F.array_position(F.array(*map(F.lit, seeds)), F.col("id")) if seeds else F.lit(0)
    order = [F.when(at > 0, at).otherwise(len(seeds) + 1), F.desc("score"), "id"]
    return scores.orderBy(*order).limit(most).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "id", "score")


def excerpt_ends(symbols: DataFrame, most: int = 80) -> DataFrame:
    """(source_file, line, end) of symbols (source_file, line, n_lines): up to the line before the next symbol, the file's last
    line, or `most` lines."""
    starts = symbols.groupBy("source_file", "line").agg(F.max("n_lines").alias("n_lines")).filter("line <= n_lines")
    after = F.lead("line").over(Window.partitionBy("source_file").orderBy("line"))
    end = F.least(F.coalesce(after - 1, F.col("n_lines")), F.col("n_lines"), F.col("line") + (most - 1))
    return starts.select("source_file", "line", F.greatest(end, F.col("line")).cast("long").alias("end"))


def uncovered(ranges: DataFrame) -> DataFrame:
    """Ranges (source_file, place, line, end) that stand in no range of their file with a better place. A range within one that
    is left out itself stands within the one that covers that, so one comparison with all better ones is enough; ranges are
    those of a ranking, some for each file."""
    better = ranges.select("source_file", F.col("place").alias("p"), F.col("line").alias("a"), F.col("end").alias("b"))
    return ranges.alias("r").join(better.alias("q"), F.expr("r.source_file = q.source_file AND q.p < r.place AND q.a <= r.line AND r.end <= q.b"), "left_anti")


def pack_chunks(files: DataFrame, budget: int) -> DataFrame:
    """(repo, path, chunk) of files (repo, path, tokens): folder by folder, in order of path, a chunk is closed where the next
    file would exceed the budget. The sum starts anew at each chunk, so the files of one repository, a row each, are walked
    in one task."""
    if budget <= 0:
        raise ValueError("the budget must be positive")

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(folder=f["path"].str.replace(r"[^/]*$", "", regex=True)).sort_values(["folder", "path"], kind="stable")
        chunks, k, used = [], 0, 0
        for n in f["tokens"].tolist():
            if used and used + n > budget:
                k, used = k + 1, 0
            chunks.append(k)
            used += n
        return pd.DataFrame({"repo": f["repo"], "path": f["path"], "chunk": chunks})

    return files.select("repo", "path", "tokens").groupBy("repo").applyInPandas(walk, "repo string, path string, chunk long")


def review_status(base: str, now: Column, stale_days: int = 14) -> Column:
    """The state of a change (base_branch, ci_status, review_decision, is_draft, updated_at): the first rule that holds."""
    return (
        F.when(F.col("base_branch") != base, "WRONG-BASE")
        .when(F.col("ci_status") == "FAILURE", "CI-FAIL")
        .when(F.col("review_decision") == "CHANGES_REQUESTED", "CHANGES-REQ")
        .when(F.col("is_draft"), "DRAFT")
        .when(F.datediff(now, F.col("updated_at")) >= stale_days, "STALE")
        .when(F.col("review_decision") == "APPROVED", "APPROVED")
        .when(F.col("ci_status") == "PENDING", "PENDING")
        .otherwise("READY")
    )


def review_conflicts(touched: DataFrame) -> DataFrame:
    """(a, b, shared): changes that touch communities (change, community) in common, and in how many."""
    sets = touched.filter("community IS NOT NULL").groupBy("community").agg(F.sort_array(F.collect_set("change")).alias("members"))
    sets = materialise(sets.filter("size(members) > 1").select("members"), "touched")
    n = F.size("members").cast("long")
    pairs = sets.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    # each change with those after it, as one row for a community: pairs are made and counted where their first change is
    after = sets.select(F.posexplode("members").alias("k", "a"), "members").filter(F.col("k") + 1 < F.size("members")).select("a", F.slice("members", F.col("k") + 2, F.size("members")).alias("after"))
    parts = max(int(touched.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS_A_TASK) + 1)
    return after.repartition(parts, "a").select("a", F.explode("after").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


#: Pairs that one task of `review_conflicts` counts, some 100 bytes each if none repeats.
PAIRS_A_TASK = 4_000_000


def overlay(nodes: DataFrame, learned: DataFrame) -> DataFrame:
    """nodes (id, hash) with what was learned (id, status, uses, hash): status, uses, and whether the code has changed since."""
    kept = learned.select("id", "status", "uses", F.col("hash").alias("then"))
    return nodes.join(kept, "id", "left").select("id", "status", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"), (F.col("then").isNotNull() & (F.col("then") != F.col("hash"))).alias("stale"))


def learned_registry(relations: DataFrame, learned: DataFrame, least: int = 3) -> DataFrame:
    """(relation, importance) of relations: the learned importance if it rests on `least` records, else the given one."""
    kept = learned.filter(F.col("exposures") >= least).select("relation", F.col("importance").alias("learned"))
    return relations.select("relation").distinct().join(kept, "relation", "left").select("relation", F.coalesce("learned", relation_importance(F.col("relation"))).alias("importance"))


def join_externals(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(id, existing): nodes without a file to the node without a file that another repository has for the label."""
    none = F.coalesce("source_file", F.lit("")) == ""
    there = known.filter(none).groupBy("label").agg(F.min("id").alias("existing"))
    return nodes.filter(none).select("id", "label").join(there, "label").filter("id <> existing").select("id", "existing")


def replace_repo(known: DataFrame, repo: str, nodes: DataFrame) -> DataFrame:
    """A table of many repositories' nodes with those of one replaced by `nodes`; give no rows to remove the repository."""
    return known.filter(F.col("repo") != repo).unionByName(nodes.withColumn("repo", F.lit(repo)).select(*known.columns))


def hub_percentile(nodes: DataFrame, edges: DataFrame, percent: float) -> DataFrame:
    """(id, degree) over the percentile of degrees: element max(0, int(n * percent / 100) - 1) in ascending order. From a
    histogram, a row for each degree."""
    d = nodes.select("id").join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    h = d.groupBy("degree").agg(F.count("*").alias("n"))
    total = h.agg(F.sum("n").alias("total"))
    upto = h.withColumn("upto", F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(total)  # one row
    at = upto.filter(F.col("upto") > F.greatest(F.lit(0), F.floor(F.col("total") * percent / 100) - 1)).agg(F.min("degree").alias("limit"))
    return d.crossJoin(at).filter(F.col("degree") > F.col("limit")).select("id", "degree")


def distinct_neighbours(edges: DataFrame, error: float = 0.02) -> DataFrame:
    """(relation, sources, targets): about how many different ends each relation has, by sketches that are merged map-side."""
    return edges.groupBy("relation").agg(F.approx_count_distinct("src", error).alias("sources"), F.approx_count_distinct("dst", error).alias("targets"))


def cost_estimate(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (backend, input_tokens, output_tokens) with its cost by prices (backend, input, output) a million tokens; a
    backend without a price costs nothing."""
    p = prices.select("backend", F.col("input").alias("pi"), F.col("output").alias("po"))
    cost = F.col("input_tokens") * F.coalesce("pi", F.lit(0.0)) / 1e6 + F.col("output_tokens") * F.coalesce("po", F.lit(0.0)) / 1e6
    return usage.join(p, "backend", "left").withColumn("cost", cost).drop("pi", "po")


def code_units(nodes: DataFrame, size: int) -> DataFrame:
    """(batch, id) of code nodes in batches of `size`, in the order of file and id. Places come from counts of files, so no
    task sorts all nodes."""
    n = nodes.filter("file_type = 'code'").select("id", "source_file")
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    start = n.groupBy("source_file").agg(F.count("*").alias("n")).select("source_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("source_file").orderBy("id")) - 1
    return n.withColumn("at", at).join(start, "source_file").select(F.floor((F.col("start") + F.col("at")) / size).cast("long").alias("batch"), "id")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): over shortest paths from the sources (all nodes unless given), the sum of the parts that pass through a node,
    undirected, each pair once if all nodes are sources. Brandes' accumulation runs for many sources at once, each a task's
    own; every task reads the whole edge list, so it is for graphs that fit into one, as a community or a scope does."""
    spark = nodes.sparkSession
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    near: dict[str, list[str]] = {}
    if e.count() > EDGES_AT_ONCE:
        raise ValueError(f"betweenness is for up to {EDGES_AT_ONCE} edges; restrict the graph")
    for a, b in e.collect():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    sent = spark.sparkContext.broadcast(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, float] = {}
        for b in batches:
            for s in b["id"]:
                order, paths, dist, back = [s], {s: 1.0}, {s: 0}, {}
                for u in order:
                    for v in sent.value.get(u, ()):
                        if v not in dist:
                            dist[v] = dist[u] + 1
                            order.append(v)
                        if dist[v] == dist[u] + 1:
                            paths[v] = paths.get(v, 0.0) + paths[u]
                            back.setdefault(v, []).append(u)
                owed = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in back.get(v, ()):
                        owed[u] += paths[u] / paths[v] * (1 + owed[v])
                    if v != s:
                        total[v] = total.get(v, 0.0) + owed[v]
        yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    from_ = nodes.select("id") if sources is None else sources.select("id")
    part = from_.distinct().mapInPandas(run, "id string, part double").groupBy("id").agg(F.sum("part").alias("score"))
    half = 0.5 if sources is None else 1.0
    return nodes.select("id").join(part, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * half).alias("score"))


#: Edges up to which `betweenness` sends the graph to all tasks, some 100 bytes each.
EDGES_AT_ONCE = 500_000
