"""Graphs in files: node-link JSON in and out, GraphML, snapshots, logs of queries, feedback and memory documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import explode_secondary
from .sinks import node_link, put

#: Bytes that a graph in one JSON document may have; beyond, write lines with `sinks.write_graph`.
MOST_BYTES = 512 << 20
# Other names that files have for the fields of nodes and edges, the first one that is there counts.
NODE_NAMES = {"id": ("id", "key", "name"), "label": ("label", "name", "title", "id"), "file_type": ("file_type", "type", "kind"), "source_file": ("source_file", "path", "file")}
EDGE_NAMES = {"src": ("source", "src", "from", "start"), "dst": ("target", "dst", "to", "end"), "relation": ("relation", "type", "label"), "confidence": ("confidence",)}


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    there = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def read_graph(spark: SparkSession, path: str, tolerant: bool = False, expand: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link document, its edges under `links` or `edges`, directed as they stand.

    tolerant: fields may have their other names, and gaps are filled. expand: secondary relations become edges of their own.
    A document over MOST_BYTES is refused: it can't be split, so one task would read it all.
    """
    fs, at = _fs(spark, path)
    if (size := fs.getContentSummary(at).getLength()) > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; a document may have {MOST_BYTES}")
    doc = spark.read.option("multiLine", True).json(path)
    listed = lambda c: c in doc.columns and doc.schema[c].dataType.simpleString().startswith("array<struct")  # noqa: E731  an empty list has no fields
    there = [c for c in ("links", "edges") if listed(c)]
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode(F.coalesce(*[F.col(c) for c in there])).alias("e")).select("e.*") if there else None
    if tolerant:
        nodes = nodes.select(*[_first(nodes, names).alias(c) for c, names in NODE_NAMES.items()]).filter("id IS NOT NULL")
        if edges is not None:
            edges = edges.select(*[_first(edges, names).alias(c) for c, names in EDGE_NAMES.items()]).filter("src IS NOT NULL AND dst IS NOT NULL")
    elif edges is not None:
        edges = edges.withColumnsRenamed({"source": "src", "target": "dst"})
    if edges is None:
        edges = spark.createDataFrame([], "src string, dst string, relation string, confidence string")
    if expand and "secondary_relations" in edges.columns:
        edges = explode_secondary(edges.select("src", "dst", "relation", "confidence", F.coalesce("secondary_relations", F.array().cast(edges.schema["secondary_relations"].dataType)).alias("secondary")))
    return nodes, edges


def read_lines(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what `sinks.write_graph` wrote: lines of JSON, split among tasks."""
    read = lambda kind, schema: spark.read.schema(schema).json(f"{path}/kind={kind}")
    return read("node", node_schema), read("link", edge_schema)


def document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (json): the node-link document; format 2 and `multigraph` if a pair has several edges."""
    e = edges.withColumnsRenamed({"src": "source", "dst": "target"})
    several = edges.groupBy("src", "dst").count().filter("count > 1").limit(1).count() > 0
    pick = lambda df: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias("x"))
    size = node_link(nodes, edges).agg(F.sum(F.length("json"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the document would have {size} bytes or more; it may have {MOST_BYTES}")
    both = pick(nodes).select(F.col("x").alias("nodes")).crossJoin(pick(e).select(F.col("x").alias("links")))  # one row each
    return both.select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(several).alias("multigraph"), F.lit(2 if several else 1).alias("format"), "nodes", "links")).alias("json"))


def write_whole(df: DataFrame, path: str, backup: str | None = None) -> None:
    """Write df as text in the place of what stands at path, see `sinks.put`."""
    put(df, path, lambda rows, at: rows.write.text(at), backup)


def _xml(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line) of a GraphML file: the head (0), nodes (1), edges (2), the foot (3). Fields that begin with _ are left out,
    lists and structures are JSON."""
    spark = nodes.sparkSession
    fields = lambda df, keys: [c for c in df.columns if c not in keys and not c.startswith("_")]
    n, e = fields(nodes, ("id",)), fields(edges, ("src", "dst"))
    plain = lambda df, c: F.to_json(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c)
    data = lambda df, cs: [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), _xml(plain(df, c)), F.lit("</data>"))).otherwise("") for c in cs]
    keys = [f'<key id="{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for k, cs in (("node", n), ("edge", e)) for c in cs]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    ends = [(0, "\n".join(head)), (3, "</graph></graphml>")]
    return (
        spark.createDataFrame(ends, "place int, line string")
        .union(nodes.select(F.lit(1), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *data(nodes, n), F.lit("</node>"))))
        .union(edges.select(F.lit(2), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), *data(edges, e), F.lit("</edge>"))))
    )


def log_query(spark: SparkSession, path: str, kind: str, question: str, corpus: str, returned: int) -> None:
    """Append a line to a log of queries; a log that can't be written stops no query."""
    row = spark.createDataFrame([(kind, question, corpus, returned)], "kind string, question string, corpus string, nodes_returned long")
    try:
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
    except Exception:  # noqa: BLE001  a log is a courtesy
        pass


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """(useful, relations, source, held_out, question) of lines of JSON; lines that aren't are passed over."""
    return spark.read.schema("useful boolean, relations array<string>, source string, held_out boolean, question string").option("mode", "DROPMALFORMED").json(path)


def memory_fields(docs: DataFrame) -> DataFrame:
    """(path, type, date, question, outcome, correction, source_nodes) of memory documents (path, text): the fields between the
    first two lines of ---, quoted or not; nodes as a list in brackets or as lines that begin with a dash."""
    front = F.regexp_extract("text", r"(?s)^---\s*\n(.*?)\n---", 1)
    raw = lambda k: F.trim(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1))
    unquoted = lambda c: F.when(c.rlike(r'^".*"$'), F.replace(F.replace(F.replace(F.expr("substring(v, 2, length(v) - 2)"), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))).otherwise(c)
    out = docs.select("path", "text")
    for k in ("type", "date", "question", "outcome", "correction"):
        out = out.withColumn("v", raw(k)).withColumn(k, unquoted(F.col("v"))).drop("v")
    bare = lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")
    inline = F.regexp_extract(front, r"(?m)^source_nodes:[ \t]*\[(.*)\]", 1)
    lines = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^source_nodes:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*([^\n]+)"), 1)
    listed = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(lines)
    return out.select("path", "type", "date", "question", "outcome", "correction", F.filter(F.transform(listed, bare), lambda x: x != "").alias("source_nodes"))


def memory_text(docs: DataFrame) -> DataFrame:
    """(path, text) of memory documents from (path, date, question, answer, outcome, source_nodes)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    nodes = F.concat(F.lit("["), F.array_join(F.transform("source_nodes", quoted), ", "), F.lit("]"))
    lines = [F.lit("---"), F.lit('type: "query"'), F.concat(F.lit("date: "), quoted(F.col("date"))), F.concat(F.lit("question: "), quoted(F.col("question"))), F.concat(F.lit("outcome: "), quoted(F.col("outcome"))), F.concat(F.lit("source_nodes: "), nodes), F.lit("---"), F.lit(""), F.coalesce("answer", F.lit(""))]
    return docs.select("path", F.concat_ws("\n", *lines).alias("text"))
