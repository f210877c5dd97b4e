"""Relational graph operators: validation, admission, survivors, degrees, set operations, diagnostics, increments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_label
from ..functions.weights import cost, edge_importance

FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
NODE_FIELDS = ("id", "label", "file_type", "source_file")
EDGE_FIELDS = ("src", "dst", "relation", "confidence")

# The language family of each file ending, by which edges across families are refused.
FAMILY_OF = {
    "py": "py", "pyi": "py", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "go": "go", "rs": "rs",
    "java": "jvm", "kt": "jvm", "scala": "jvm", "groovy": "jvm", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "cxx": "c", "hh": "c", "hxx": "c", "cu": "c", "cuh": "c", "metal": "c", "m": "c", "mm": "c",
    "rb": "rb", "rake": "rb", "php": "php", "cs": "cs", "swift": "swift", "lua": "lua",
}
# Keys that JSON files have everywhere; as labels of nodes of such files they are noise.
JSON_KEYS = (
    "start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version",
    "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies",
)
# Names of languages and their libraries, which are noise as labels in any file.
BUILTINS = (
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object", "True", "False",
    "MagicMock", "Mock", "AsyncMock", "NonCallableMock", "NonCallableMagicMock", "PropertyMock", "patch", "sentinel",
    "Path", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "ClassVar", "Final", "Literal", "Protocol",
    "Counter", "defaultdict", "OrderedDict", "datetime", "Enum", "os", "sys", "re", "json", "io", "abc", "typing",
    "Foundation", "SwiftUI", "UIKit", "AppKit", "Combine", "String", "Int", "Double", "Float", "Bool", "Data", "URL", "Date", "UUID",
    "Sendable", "Codable", "Decodable", "Encodable", "Equatable", "Hashable", "Identifiable", "Comparable", "AnyObject", "Error", "LocalizedError",
    "NSObject", "NSString", "NSError", "NSLock", "View", "Color", "Font", "DispatchQueue",
)


def family(path: Column) -> Column:
    """The language family of a file, null if its ending has none."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in FAMILY_OF.items() for x in pair])[ending]


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, problem) for each missing field, unknown type or confidence, and endpoint that no node has."""
    missing = lambda df, kind, key, fields: [df.filter(F.col(f).isNull() | (F.col(f) == "")).select(F.lit(kind).alias("kind"), key.alias("id"), F.lit(f"missing {f}").alias("problem")) for f in fields]
    edge_key = F.concat_ws(">", F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit("")))
    odd = [
        nodes.filter(F.col("file_type").isNotNull() & ~F.col("file_type").isin(*FILE_TYPES)).select(F.lit("node").alias("kind"), F.col("id"), F.lit("unknown file_type").alias("problem")),
        edges.filter(F.col("confidence").isNotNull() & ~F.col("confidence").isin(*CONFIDENCES)).select(F.lit("edge").alias("kind"), edge_key.alias("id"), F.lit("unknown confidence").alias("problem")),
    ]
    ids = nodes.select(F.col("id").alias("node"))
    loose = [edges.join(ids, F.col(c) == F.col("node"), "left_anti").filter(F.col(c).isNotNull()).select(F.lit("edge").alias("kind"), edge_key.alias("id"), F.lit(f"dangling {c}").alias("problem")) for c in ("src", "dst")]
    return reduce(DataFrame.union, [*missing(nodes, "node", F.col("id"), NODE_FIELDS), *missing(edges, "edge", edge_key, EDGE_FIELDS), *odd, *loose])


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select(F.col("id").alias("node"))
    return edges.join(ids, F.col("src") == F.col("node"), "left_semi").join(ids, F.col("dst") == F.col("node"), "left_semi")


def admit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that a graph takes: both ends exist; no inferred call, no import or reference across language families; no
    import of itself; of two edges of one relation in opposite directions the one from the lesser end."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), family(F.col("source_file")).alias(f"{p}_family"))
    e = edges.join(side("s"), F.col("src") == F.col("s_id")).join(side("t"), F.col("dst") == F.col("t_id"))
    across = F.coalesce(F.col("s_family") != F.col("t_family"), F.lit(False))
    e = e.filter(~(across & (((F.col("relation") == "calls") & (F.col("confidence") == "INFERRED")) | F.col("relation").isin("imports", "imports_from", "references"))))
    e = e.filter(~(F.col("relation").isin("imports", "imports_from") & (F.col("src") == F.col("dst"))))
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"), "relation")
    return e.withColumn("first", F.min("src").over(pair)).filter(F.col("src") == F.col("first")).select(*edges.columns)


def in_context(edges: DataFrame, contexts: list[str]) -> DataFrame:
    return edges.filter(F.col("context").isin(*contexts)) if contexts else edges


def last_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of the rows of a key the one with the greatest seq, as it is."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(seq)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def survivors(nodes: DataFrame) -> DataFrame:
    """One node of each id: of those in one file the values that the first has, gaps filled from the next ones; among files
    the node that names itself in its id, then the shortest label, label and file decide."""
    own = F.when(F.contains(F.col("id"), F.replace(norm_label(F.col("label")), F.lit(" "), F.lit("_"))), 0).otherwise(1)
    ranked = nodes.withColumns({"own": own, "size": F.length("label")})
    order = F.struct("own", "size", "label", "source_file")
    w = Window.partitionBy("id", "source_file").orderBy("own", "size", "label").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = [c for c in nodes.columns if c not in ("id", "label", "source_file")]
    filled = ranked.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in rest})
    return filled.groupBy("id").agg(F.min_by(F.struct("label", "source_file", *rest), order).alias("r")).select("id", "r.*").select(*nodes.columns)


def with_importance(edges: DataFrame) -> DataFrame:
    return edges.withColumn("importance", edge_importance(F.col("relation"), F.col("confidence")))


def best_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, importance): the most important edge of each directed pair."""
    return with_importance(edges).groupBy("src", "dst").agg(F.max("importance").alias("importance"))


def undirected_costs(edges: DataFrame) -> DataFrame:
    """(a, b, cost): the least cost of each unordered pair."""
    return with_importance(edges).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(cost(F.col("importance"))).alias("cost"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): a loop counts twice. Partial sums meet, so a hub is no burden on one task."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def is_file_label(label: Column, path: Column) -> Column:
    """The label is the file's name, or an ending of its path in whole segments."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    return (label == F.element_at(F.split(unix, "/"), -1)) | (F.contains(label, F.lit("/")) & ((unix == label) | F.endswith(unix, F.concat(F.lit("/"), label))))


def is_file_node(label: Column, path: Column, degree: Column | None = None) -> Column:
    """Nodes that stand for a file, and stubs of methods: `.name()`, and `name()` with one edge at most."""
    named = F.coalesce((path != "") & is_file_label(label, path), F.lit(False))
    call = F.endswith(label, F.lit("()"))
    stub = F.startswith(label, F.lit(".")) & call
    if degree is not None:
        stub = stub | (call & (F.coalesce(degree, F.lit(0)) <= 1))
    return F.coalesce((label != "") & (named | stub), F.lit(False))


def is_noise(label: Column, path: Column) -> Column:
    json_key = F.endswith(F.lower(F.coalesce(path, F.lit(""))), F.lit(".json")) & F.lower(F.trim(label)).isin(*JSON_KEYS)
    return F.coalesce(json_key | label.isin(*BUILTINS), F.lit(False))


def is_concept_node(path: Column) -> Column:
    return path.isNull() | (path == "") | ~F.contains(F.element_at(F.split(path, "/"), -1), F.lit("."))


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The nodes with the most edges, without file and concept nodes, method stubs and noise labels; ties go to the lesser id."""
    label, path = F.coalesce("label", F.lit("")), F.col("source_file")
    all_ = degrees(edges).join(nodes.select("id", "label", "source_file"), "id")
    real = all_.filter(~is_file_node(label, path, F.col("degree")) & ~is_concept_node(path) & ~is_noise(label, path))
    return real.select("id", F.coalesce("label", "id").alias("label"), "degree").orderBy(F.desc("degree"), "id").limit(top)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, communities, and the whole percent of edges of each confidence, halves to even."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    part = lambda c: F.bround(F.sum(F.when(F.col("confidence") == c, 1).otherwise(0)) * 100.0 / F.count("*")).cast("long")
    e = edges.agg(F.count("*").alias("edges"), *[part(c).alias(c.lower()) for c in CONFIDENCES])
    return n.crossJoin(e)  # one row each


def hub_threshold(nodes: DataFrame, edges: DataFrame, part: float = 0.99, least: int = 50, degree: DataFrame | None = None) -> DataFrame:
    """One row: the greater of `least` and element int(part * n) of the ascending degrees. From a histogram of degrees,
    not from sorted nodes; a node without edges has degree 0."""
    seen = (degrees(edges) if degree is None else degree).join(nodes.select("id"), "id", "left_semi").groupBy("degree").agg(F.count("*").alias("n"))
    total = nodes.agg(F.count("*").alias("total"))
    with_edges = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("has"))
    alone = total.crossJoin(with_edges).select(F.lit(0).cast("long").alias("degree"), (F.col("total") - F.col("has")).alias("n"))
    up = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)  # one row a degree
    place = seen.union(alone).groupBy("degree").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(up)).crossJoin(total)
    at = place.filter(F.col("upto") > F.floor(F.lit(part) * F.col("total"))).agg(F.min("degree").alias("d"))
    return at.select(F.greatest(F.coalesce("d", F.lit(0)), F.lit(least)).cast("long").alias("threshold"))


def isolated(nodes: DataFrame, edges: DataFrame, most: int = 1) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree")).filter(F.col("degree") <= most)


def short_paths(paths: DataFrame, column: str = "source_file") -> DataFrame:
    """(source_file, short): the shortest ending of each path, in whole segments, that no other path has."""
    p = paths.select(F.col(column).alias("source_file")).distinct().withColumn("parts", F.split("source_file", "/"))
    ends = p.select("source_file", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"), "parts")
    ends = ends.withColumn("short", F.array_join(F.slice("parts", F.size("parts") - F.col("k") + 1, F.col("k")), "/"))
    # how many paths share an ending: sums meet, so a common file name isn't gathered in one task
    alone = ends.groupBy("short").agg(F.count("*").alias("n"), F.min("source_file").alias("source_file"), F.min("k").alias("k")).filter("n = 1")
    best = alone.groupBy("source_file").agg(F.min_by("short", F.col("k")).alias("short"))
    return p.select("source_file").join(best, "source_file", "left").select("source_file", F.coalesce("short", "source_file").alias("short"))


def graph_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that only one side has, with change `added` or `removed`; copies don't count."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def edge_keys(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation")


def compose(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The union; where both have a key, the right one's values win."""
    return last_wins(left.withColumn("seq", F.lit(0)).unionByName(right.withColumn("seq", F.lit(1))), keys).drop("seq")


def prefixed(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """A graph whose ids carry the name of their repository."""
    p = F.lit(f"{tag}::")
    return nodes.withColumns({"local_id": F.col("id"), "repo": F.lit(tag), "id": F.concat(p, "id")}), edges.withColumns({"src": F.concat(p, "src"), "dst": F.concat(p, "dst")})


def replace_sources(old: DataFrame, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """old without the rows of source files that new has or that were deleted, and new; a file in both is replaced."""
    gone = new.select("source_file")
    if deleted is not None:
        gone = gone.union(deleted.select("source_file"))
    return old.join(gone.distinct(), "source_file", "left_anti").select(*old.columns).unionByName(new)


def unexplained_losses(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Nodes that were lost though their file wasn't rebuilt; a writer refuses if there are any."""
    lost = old.join(new.select("id"), "id", "left_anti")
    return lost.join(rebuilt.select("source_file").distinct(), "source_file", "left_anti").select("id", "source_file")


def diagnose(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, from one pass over the edges: edges, loops, repeated (src, dst, relation), pairs with several
    relations, pairs' other edges, dangling ones."""
    ids = nodes.select(F.col("id").alias("node"), F.lit(True).alias("known")).distinct()
    by_pair = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.countDistinct("relation").alias("kinds"))
    for c in ("src", "dst"):
        by_pair = by_pair.join(ids.withColumnsRenamed({"node": c, "known": f"{c}_known"}), c, "left")
    lost = F.col("src_known").isNull() | F.col("dst_known").isNull()
    return by_pair.agg(
        F.sum("n").alias("edges"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("loops"), F.sum(F.col("n") - F.col("kinds")).alias("repeats"),
        F.sum((F.col("kinds") > 1).cast("long")).alias("variants"), F.sum(F.col("n") - 1).alias("collapsed"), F.sum(F.when(lost, F.col("n")).otherwise(0)).alias("dangling"),
    )


def explode_secondary(edges: DataFrame) -> DataFrame:
    """Structural edges, and one more for each secondary relation that its pair doesn't have yet."""
    more = edges.select("src", "dst", F.explode("secondary").alias("s")).select("src", "dst", "s.relation", "s.confidence").distinct()
    plain = edges.select("src", "dst", "relation", "confidence")
    return plain.union(more.join(plain, ["src", "dst", "relation"], "left_anti").select("src", "dst", "relation", "confidence"))


def restore_layer(previous: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 8) -> DataFrame:
    """Edges (src, dst, relation, secondary) after a rebuild: annotations of `previous` (src, dst, relation) go back onto the
    edge that joins their ends in either direction, at most `most` each; where there is none they become edges; where an end
    is gone they go."""
    pair = lambda df: df.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    notes = pair(prune_dangling(nodes, previous)).groupBy("a", "b").agg(F.sort_array(F.collect_set("relation")).alias("notes"), F.min(F.struct("src", "dst")).alias("first"))
    carriers = pair(edges)
    kept = carriers.join(notes.drop("first"), ["a", "b"], "left").select("src", "dst", "relation", F.coalesce(F.slice("notes", 1, most), F.array().cast("array<string>")).alias("secondary"))
    alone = notes.join(carriers.select("a", "b").distinct(), ["a", "b"], "left_anti")
    return kept.union(alone.select("first.src", "first.dst", F.col("notes")[0].alias("relation"), F.slice("notes", 2, most).alias("secondary")))


def clean_hyperedges(hyper: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Hyperedges (id, nodes) with their known members in order, if at least `least` are left."""
    m = hyper.select("id", F.explode("nodes").alias("node")).distinct().join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return m.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("nodes")).filter(F.size("nodes") >= least)


def parallel_relations(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sort_array(F.collect_set("relation")).alias("relations"))


def neighbours(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """(direction, id, relation, confidence) of the edges of a node, both filters pushed to the scan of edges."""
    e = edges if relation is None else edges.filter(F.contains(F.col("relation"), F.lit(relation)))
    out = e.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "relation", "confidence")
    return out.union(e.filter(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "relation", "confidence"))


def tree_counts(nodes: DataFrame) -> DataFrame:
    """(prefix, depth, n): the nodes at or below each folder."""
    parts = F.split("source_file", "/")
    by_file = nodes.groupBy("source_file").agg(F.count("*").alias("n"))
    up = by_file.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("prefix"), k.alias("depth")))).alias("p"), "n")
    return up.groupBy("p.prefix", "p.depth").agg(F.sum("n").alias("n")).select("prefix", F.col("depth").cast("long").alias("depth"), "n")


def change_impact(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(change, communities, nodes) for change sets (change, path); a path stands for files equal to it or ending in it.
    Files are matched by each of their endings, so it is an equi-join."""
    parts = F.split("source_file", "/")
    files = nodes.groupBy("source_file", "community").agg(F.count("*").alias("n"))
    ends = files.select("source_file", "community", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("path"))
    hit = ends.join(changed, "path").select("change", "source_file", "community", "n").distinct()
    return hit.groupBy("change").agg(F.countDistinct("community").alias("communities"), F.sum("n").alias("nodes"))


def section_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section_a, section_b, relation, n) of edges between top folders."""
    top = nodes.select(F.col("id"), F.substring_index("source_file", "/", 1).alias("section"))
    e = edges.join(top.select(F.col("id").alias("src"), F.col("section").alias("section_a")), "src").join(top.select(F.col("id").alias("dst"), F.col("section").alias("section_b")), "dst")
    return e.groupBy("section_a", "section_b", "relation").agg(F.count("*").alias("n"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    e = with_importance(edges).select(F.explode(F.array("src", "dst")).alias("id"), "importance")
    return e.groupBy("id").agg(F.sum("importance").alias("weight"))
