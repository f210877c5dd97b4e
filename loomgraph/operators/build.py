"""From extracted fragments to a graph: aliases, paths, types, limits, twins, edge order, hyperedges, and what a rebuild keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from .graph import admit, clean_hyperedges, last_wins, short_paths

# Other names of file types.
TYPE_SYNONYMS = {
    "markdown": "document", "text": "document", "tool": "code", "library": "code", "pattern": "concept", "principle": "concept", "constraint": "concept",
    "tech": "concept", "technology": "concept", "data-source": "concept", "data_source": "concept", "gotcha": "concept", "framework": "concept",
}
# The most that one fragment may hold.
LIMITS = {"bytes": 25 * 1024 * 1024, "nodes": 10_000, "edges": 100_000, "hyperedges": 10_000, "members": 256}
ID_PATTERN = r"^[\p{L}\p{N}_.:-]+$"


def _or(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _filled(first: Column, other: Column) -> Column:
    """first, unless it is null or empty and other is not."""
    return F.when((F.coalesce(first, F.lit("")) == "") & (F.coalesce(other, F.lit("")) != ""), other).otherwise(first)


def fold_node_aliases(nodes: DataFrame) -> DataFrame:
    """`name` fills an empty label, `path` an empty source_file."""
    return nodes.withColumns({"label": _filled(_or(nodes, "label"), _or(nodes, "name")), "source_file": _filled(_or(nodes, "source_file"), _or(nodes, "path"))})


def fold_edge_aliases(edges: DataFrame) -> DataFrame:
    """`type` fills an empty relation; a score without a confidence means INFERRED."""
    score = _or(edges, "confidence_score", "double")
    confidence = F.when((F.coalesce(_or(edges, "confidence"), F.lit("")) == "") & score.isNotNull(), "INFERRED").otherwise(_or(edges, "confidence"))
    return edges.withColumns({"relation": _filled(_or(edges, "relation"), _or(edges, "type")), "confidence": confidence})


def norm_path(path: Column, root: str | None = None) -> Column:
    """Slashes forward; an absolute path below root becomes relative to it."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    if not root:
        return unix
    top = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(unix, F.lit(top)), F.substring(unix, len(top) + 1, 1 << 30)).otherwise(unix)


def file_type(kind: Column) -> Column:
    """A known file type from one of its other names."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_SYNONYMS.items() for x in pair])
    return F.coalesce(known[F.lower(kind)], kind)


def fragment_errors(fragments: DataFrame) -> DataFrame:
    """(fragment, problem) for fragments (fragment, bytes, nodes array<string>, edges array<struct<source, target>>, hyperedges
    array<array<string>>) beyond LIMITS, or with an id that isn't one."""
    bad = lambda c: c.isNull() | ~c.rlike(ID_PATTERN)
    checks = F.array(
        F.when(F.col("bytes") > LIMITS["bytes"], "too many bytes"),
        F.when(F.size("nodes") > LIMITS["nodes"], "too many nodes"),
        F.when(F.size("edges") > LIMITS["edges"], "too many edges"),
        F.when(F.size("hyperedges") > LIMITS["hyperedges"], "too many hyperedges"),
        F.when(F.exists("hyperedges", lambda h: F.size(h) > LIMITS["members"]), "too many members"),
        F.when(F.exists("nodes", bad), "bad node id"),
        F.when(F.exists("edges", lambda e: bad(e["source"]) | bad(e["target"])), "bad edge end"),
    )
    return fragments.select("fragment", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def doc_twins(nodes: DataFrame) -> DataFrame:
    """(id, twin): documents `x` that a document `x_doc` of the same file stands for."""
    docs = nodes.filter("file_type = 'document' AND coalesce(source_file, '') <> ''").select("id", "source_file")
    twin = docs.filter(F.endswith("id", F.lit("_doc"))).select(F.col("id").alias("twin"), F.expr("substring(id, 1, length(id) - 4)").alias("id"), "source_file")
    return docs.join(twin, ["id", "source_file"]).select("id", "twin")


def remap_ids(nodes: DataFrame, edges: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the ids of remap (id, twin) replaced; a node whose twin exists goes, edges onto themselves go."""
    there = nodes.select(F.col("id").alias("twin")).distinct()
    gone = remap.join(there, "twin", "left_semi").select("id")
    n = nodes.join(gone, "id", "left_anti").join(remap, "id", "left").withColumn("id", F.coalesce("twin", "id")).drop("twin")
    e = edges
    for c in ("src", "dst"):
        e = e.join(remap.select(F.col("id").alias(c), "twin"), c, "left").withColumn(c, F.coalesce("twin", c)).drop("twin")
    return n.select(*nodes.columns), e.filter("src <> dst").select(*edges.columns)


def one_edge_a_pair(edges: DataFrame) -> DataFrame:
    """What a graph with one edge a pair holds: of each pair of ends, in the order of (src, dst, relation), the last edge; an
    edge against the direction of one of the same relation doesn't count."""
    pair = {"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}
    e = edges.withColumns(pair)
    first = e.groupBy("a", "b", "relation").agg(F.min("src").alias("first"))
    e = e.join(first, ["a", "b", "relation"]).filter(F.col("src") == F.col("first")).drop("first")
    rest = [c for c in edges.columns if c not in ("src", "dst", "relation")]
    return e.groupBy("a", "b").agg(F.max(F.struct("src", "dst", "relation", *rest)).alias("e")).select("e.*").select(*edges.columns)


def build(nodes: DataFrame, edges: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of concatenated fragments: nodes (seq, id, ...) and edges (src, dst, ...) with aliases folded, paths and file
    types normalised, document twins joined, the last node of an id, admitted edges, and one edge a pair."""
    n = fold_node_aliases(nodes)
    n = n.withColumns({"source_file": norm_path(F.col("source_file"), root), "file_type": file_type(F.col("file_type"))})
    n = last_wins(n.select("seq", "id", "label", "file_type", "source_file").dropna(subset=["id"]), ["id"]).drop("seq")
    e = fold_edge_aliases(edges).select("src", "dst", "relation", "confidence")
    n, e = remap_ids(n, e, doc_twins(n))
    return relabel_files(n), one_edge_a_pair(admit(n, e))


def relabel_files(nodes: DataFrame) -> DataFrame:
    """File nodes whose file name another file has too are labelled by the shortest ending of the path that tells them apart."""
    from .graph import is_file_label

    named = nodes.withColumn("__file", F.coalesce((F.col("source_file") != "") & is_file_label(F.col("label"), F.col("source_file")), F.lit(False)))
    files = named.filter("__file").select("source_file").distinct().withColumn("name", F.element_at(F.split("source_file", "/"), -1))
    many = files.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    short = short_paths(files.join(many, "name", "left_semi"))
    out = named.join(short, "source_file", "left")
    return out.withColumn("label", F.when(F.col("__file") & F.col("short").isNotNull(), F.col("short")).otherwise(F.col("label"))).select(*nodes.columns)


def union_hyperedges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hyperedges of both by id; those of old win."""
    return old.unionByName(new.join(old.select("id"), "id", "left_anti").select(*old.columns))


def hyperedges_of(hyper: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hyperedges (id, nodes or members or node_ids) with known members only; those with none go."""
    members = F.coalesce(*[F.col(c) for c in ("nodes", "members", "node_ids") if c in hyper.columns])
    return clean_hyperedges(hyper.select("id", members.alias("nodes")), nodes, 1)


def topology_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(side, ...) rows that only one of two tables has, counted; none: the topology is the same. Columns of layout and
    communities are left out."""
    cols = sorted(c for c in set(old.columns) & set(new.columns) if c not in ("community", "community_name", "x", "y"))
    both = old.select(*cols, F.lit(1).alias("__n")).union(new.select(*cols, F.lit(-1).alias("__n")))
    left = both.groupBy(*cols).agg(F.sum("__n").alias("n")).filter("n <> 0")
    return left.select(F.when(F.col("n") > 0, "old").otherwise("new").alias("side"), *cols, F.abs("n").alias("n"))


def stale_sources(nodes: DataFrame, scanned: DataFrame) -> DataFrame:
    """(source_file): files of nodes that a scan (path) no longer finds."""
    return nodes.filter("coalesce(source_file, '') <> ''").select("source_file").distinct().join(scanned.select(F.col("path").alias("source_file")), "source_file", "left_anti")


def split_changes(changes: DataFrame, scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, change) of changed paths: `extract` if a scan has it, `delete` if only the graph has it, else `ignore`."""
    seen = scanned.select("path", F.lit(True).alias("seen")).distinct()
    held = nodes.select(F.col("source_file").alias("path"), F.lit(True).alias("held")).distinct()
    c = changes.select("path").distinct().join(seen, "path", "left").join(held, "path", "left")
    return c.select("path", F.when(F.col("seen"), "extract").when(F.col("held"), "delete").otherwise("ignore").alias("change"))


def kept_labels(labels: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """(community, label) of labels whose community's members (community, id) are the same in both runs."""
    sign = lambda m: m.groupBy("community").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id") % 1_000_003).alias("s"))
    same = sign(before).join(sign(now), ["community", "n", "x", "s"]).select("community")
    return labels.join(same, "community", "left_semi").select("community", "label")


def relabel_communities(matched: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, new_id): what matching (community, new_id) gives, and for the others ids above all given ones, the larger
    community first."""
    top = matched.agg(F.coalesce(F.max("new_id"), F.lit(-1)).alias("top"))
    rest = communities.join(matched, "community", "left_anti").crossJoin(top)  # one row
    place = F.row_number().over(Window.orderBy(F.desc("size"), "community"))  # a row a community
    return matched.select("community", "new_id").union(rest.select("community", (F.col("top") + place).cast("long")))


def sanitize_label(text: Column, most: int = 256) -> Column:
    """Without control characters, at most `most` characters."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, most)


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def diagram_edges(edges: DataFrame, least: float = 0.85) -> DataFrame:
    """Edges that a diagram shows: extracted ones, and inferred ones with a score of at least `least`."""
    return edges.filter((F.col("confidence") == "EXTRACTED") | ((F.col("confidence") == "INFERRED") & (F.col("confidence_score") >= least)))


# File endings that a label must not have to be a symbol.
SYMBOL_ENDINGS = (".py", ".js", ".ts", ".tsx", ".java", ".go", ".rs")


def callable_key(label: Column) -> Column:
    """The key by which calls find a label: without parentheses at its ends and leading dots, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"^[()]+|[()]+$", ""), r"^\.+", ""))


def is_symbol(kind: Column, label: Column) -> Column:
    """Nodes that a call may mean: code, with a label that is no file's."""
    named = F.trim(F.coalesce(label, F.lit("")))
    file = F.lit(False)
    for end in SYMBOL_ENDINGS:
        file = file | F.endswith(named, F.lit(end))
    return F.coalesce((kind == "code") & ~file & (callable_key(named) != ""), F.lit(False))


def import_uses(imports: DataFrame, classes: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst): each class of a file (id, source_file) uses what the file imports (source_file, module, name), found among
    entities (id, module, name). Classes and what files import are made distinct before they meet, so the pairs, which are as many as
    the product of both, are put out as they come: neither sorted nor shuffled, but for those of classes of several files. A
    file's imports are dealt over 16 parts, each with the file's classes, as files may be few."""
    found = imports.distinct().join(entities.select(F.col("id").alias("dst"), "module", "name"), ["module", "name"]).select("source_file", "dst").distinct()
    found = found.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(16)).cast("int"))
    c = classes.select(F.col("id").alias("src"), "source_file").filter("source_file IS NOT NULL").groupBy("src").agg(F.collect_set("source_file").alias("files"))
    c = c.select("src", (F.size("files") > 1).alias("many"), F.explode("files").alias("source_file"))
    c = c.select("src", "many", "source_file", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part"))
    pairs = lambda some: found.join(c.filter(some), ["source_file", "part"]).filter("src <> dst").select("src", "dst")
    return pairs("NOT many").union(pairs("many").distinct())


def prefer_tests(candidates: DataFrame) -> DataFrame:
    """candidates (call_id, source_file, id, candidate_file) without those of tests, if the call isn't in a test; in a test,
    only those of tests if there are any."""
    c = candidates.withColumns({"in_test": is_test_path(F.col("source_file")), "of_test": is_test_path(F.col("candidate_file"))})
    some = c.filter("in_test AND of_test").select("call_id").distinct().withColumn("some", F.lit(True))
    c = c.join(some, "call_id", "left").filter("(NOT in_test AND NOT of_test) OR (in_test AND (of_test OR some IS NULL))")
    return c.select(*candidates.columns)

