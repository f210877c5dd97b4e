"""Writers of graphs: JSON lines of nodes and links, and Cypher statements."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import CONFIDENCE_SCORE
from ..operators.graph import unexplained_losses


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json) of each node and edge; an edge without a score gets that of its confidence."""
    scores = F.create_map(*[F.lit(x) for kv in CONFIDENCE_SCORE.items() for x in kv])
    e = edges.withColumn("confidence_score", F.coalesce(F.col("confidence_score") if "confidence_score" in edges.columns else F.lit(None).cast("double"), scores[F.col("confidence")]))
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return rows(nodes, "node").union(rows(e, "link"))


def put(df: DataFrame, path: str, write, backup: str | None = None) -> None:
    """Write df beside path by write(df, where), then put it in its place: df may be read from path, and readers see the old
    files or the new ones. backup: a name under which what stood there is kept."""
    spark = df.sparkSession
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{backup or uuid.uuid4().hex}"
    write(df, fresh)
    was = fs.exists(at(path))
    if was and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(at(fresh), at(path)):
        if was:
            fs.rename(at(old), at(path))
        raise OSError(f"{path} can't be written")
    if was and not backup:
        fs.delete(at(old), True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, previous: DataFrame | None = None, rebuilt: DataFrame | None = None) -> None:
    """Write both kinds below path, in one folder each; refuse if nodes of `previous` are gone whose files weren't rebuilt."""
    if previous is not None:
        lost = unexplained_losses(previous, nodes, rebuilt if rebuilt is not None else previous.limit(0)).limit(1).count()
        if lost:
            raise ValueError("nodes were lost whose files weren't rebuilt")
    put(node_link(nodes, edges), path, lambda df, at: df.write.partitionBy("kind").text(at))


def _quoted(c: Column) -> Column:
    text = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, statement): MERGE of all nodes (place 0), then of all edges (1). Relation names keep letters, digits and _."""
    n = nodes.select(F.lit(0).alias("place"), F.concat(F.lit("MERGE (n:Node {id: "), _quoted(F.col("id")), F.lit("}) SET n.label = "), _quoted(F.col("label")), F.lit(";")).alias("statement"))
    kind = F.upper(F.regexp_replace(F.coalesce("relation", F.lit("RELATED")), "[^A-Za-z0-9_]", "_"))
    e = edges.select(F.lit(1).alias("place"), F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("src")), F.lit("}), (b {id: "), _quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b);")).alias("statement"))
    return n.union(e)
