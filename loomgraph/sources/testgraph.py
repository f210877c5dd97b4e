"""Graphs over ordinary tables: trade (G1), dialogue (G2), documents (G3), events (G4); each with the SQL that DuckDB builds it by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import spread, table


@dataclass(frozen=True)
class Graph:
    """nodes(id, label, file_type, source_file, community, ...), edges(src, dst, relation, confidence, context, source_file, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def undirected(self) -> DataFrame:
        """Each edge in both directions, as (src, dst, ...)."""
        e = self.edges
        return e.unionByName(e.withColumnsRenamed({"src": "dst", "dst": "src"}))


def _confidence(c) -> F.Column:
    return F.when(c.isin("N", "F"), "EXTRACTED").when(c.isin("A", "O"), "INFERRED").otherwise("AMBIGUOUS")


def _rank(c: str) -> F.Column:
    """A number for a status that keeps the order of texts and tells A, F, N and O from all others. Least and greatest numbers are
    hashed where texts would be sorted by every task."""
    k = F.when(F.col(c).isNull(), F.lit(None).cast("int"))
    for n, x in enumerate("AFNO"):
        k = k.when(F.col(c) < x, 2 * n).when(F.col(c) == x, 2 * n + 1)
    return k.otherwise(8)


def _confidence_of(rank: F.Column) -> F.Column:
    return F.when(rank.isin(3, 5), "EXTRACTED").when(rank.isin(1, 7), "INFERRED").otherwise("AMBIGUOUS")


def trade(spark: SparkSession, d: str) -> Graph:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    home = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", "r_name")  # a dimension of 25 rows
    home = F.broadcast(home)
    place = F.concat_ws("/", "r_name", "n_name")
    named = lambda kind, key: F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))
    customer = table(spark, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, d, "part")
    node = lambda df, kind, key, label, file_type, file, community: df.select(named(kind, key).alias("id"), F.col(label).alias("label"), F.lit(file_type).alias("file_type"), file.alias("source_file"), community.cast("int").alias("community"))
    nodes = (
        node(region, "region", "r_regionkey", "r_name", "concept", F.concat("r_name", F.lit("/region.md")), F.col("r_regionkey"))
        .union(node(home, "nation", "n_nationkey", "n_name", "concept", F.concat(place, F.lit("/nation.md")), F.col("n_regionkey")))
        .union(node(customer, "customer", "c_custkey", "c_name", "code", F.concat(place, F.lit("/customer.py")), F.col("n_regionkey")))
        .union(node(supplier, "supplier", "s_suppkey", "s_name", "code", F.concat(place, F.lit("/supplier.java")), F.col("n_regionkey")))
        .union(node(part, "part", "p_partkey", "p_name", "code", F.concat(F.lit("parts/"), "p_brand", F.lit("/part.py")), F.col("p_size") % 5))
    )
    line = table(spark, d, "lineitem")
    bought = table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", _rank("o_orderstatus").alias("s"))
    # keys seldom repeat within a task, so rows are dealt before they are gathered: no task's table grows with its share of a file
    bought = spread(bought, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.min("s").alias("s"))
    supplied = spread(line.select("l_partkey", "l_suppkey", _rank("l_returnflag").alias("s")), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.max("s").alias("s"))
    edge = lambda df, a, b, relation, confidence, context: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"), confidence.alias("confidence"), F.lit(context).cast("string").alias("context"))
    sure = F.lit("EXTRACTED")
    edges = (
        edge(nation, named("nation", "n_nationkey"), named("region", "n_regionkey"), "inherits", sure, None)
        .union(edge(table(spark, d, "customer"), named("customer", "c_custkey"), named("nation", "c_nationkey"), "references", sure, "field"))
        .union(edge(table(spark, d, "supplier"), named("supplier", "s_suppkey"), named("nation", "s_nationkey"), "references", sure, "field"))
        .union(edge(supplied, named("part", "l_partkey"), named("supplier", "l_suppkey"), "imports", _confidence_of(F.col("s")), "import"))
        .union(edge(bought, named("customer", "o_custkey"), named("part", "l_partkey"), "calls", _confidence_of(F.col("s")), "call"))
    )
    return Graph(nodes, edges)


TRADE_SQL = """
home AS (SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
SELECT 'region_' || r_regionkey AS id, r_name AS label, 'concept' AS file_type, r_name || '/region.md' AS source_file, r_regionkey::INTEGER AS community FROM region
UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'concept', r_name || '/' || n_name || '/nation.md', n_regionkey::INTEGER FROM home
UNION ALL SELECT 'customer_' || c_custkey, c_name, 'code', r_name || '/' || n_name || '/customer.py', n_regionkey::INTEGER FROM customer JOIN home ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'code', r_name || '/' || n_name || '/supplier.java', n_regionkey::INTEGER FROM supplier JOIN home ON s_nationkey = n_nationkey
UNION ALL SELECT 'part_' || p_partkey, p_name, 'code', 'parts/' || p_brand || '/part.py', (p_size % 5)::INTEGER FROM part),
edges AS MATERIALIZED (
SELECT 'nation_' || n_nationkey AS src, 'region_' || n_regionkey AS dst, 'inherits' AS relation, 'EXTRACTED' AS confidence, NULL::VARCHAR AS context FROM nation
UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'references', 'EXTRACTED', 'field' FROM customer
UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'references', 'EXTRACTED', 'field' FROM supplier
UNION ALL SELECT 'part_' || l_partkey, 'supplier_' || l_suppkey, 'imports', CASE max(l_returnflag) WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, 'import' FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT 'customer_' || o_custkey, 'part_' || l_partkey, 'calls', CASE min(o_orderstatus) WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, 'call' FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey)
"""


_ENDINGS = ("py", "c", "rb", "json", "md", "go", "vue", "cs", "m")


def mixed(spark: SparkSession, d: str) -> Graph:
    """Parts as nodes of files in many languages, some with labels that are noise, stubs or files; lines as edges between them."""
    k = F.col("p_partkey")
    ending = F.array(*map(F.lit, _ENDINGS))[(k % len(_ENDINGS)).cast("int")]
    file = F.when(k % 41 == 0, "").when(k % 43 == 0, "folder/noend").otherwise(F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/f"), (k % 50).cast("string"), F.lit("."), ending))
    label = F.when(k % 11 == 0, "data").when(k % 13 == 0, "str").when(k % 17 == 0, ".run()").when(k % 19 == 0, "go()").when(k % 23 == 0, F.element_at(F.split(file, "/"), -1)).when(k % 29 == 0, file).otherwise(F.col("p_name"))
    name = lambda c: F.concat(F.lit("part_"), c.cast("string"))
    nodes = table(spark, d, "part").select(name(k).alias("id"), label.alias("label"), F.lit("code").alias("file_type"), file.alias("source_file"), (k % 6).cast("int").alias("community"))
    other = (F.col("l_partkey") * 7 + F.col("l_linenumber") * F.col("l_linenumber")) % 300 + 1
    relation = F.array(*map(F.lit, ("calls", "imports", "references", "uses", "semantically_similar_to", "contains", "calls")))[F.col("l_linenumber") - 1]
    edges = table(spark, d, "lineitem").select(name(F.col("l_partkey")).alias("src"), name(other).alias("dst"), relation.alias("relation"), _confidence(F.col("l_returnflag")).alias("confidence"), F.lit(None).cast("string").alias("context"))
    return Graph(nodes, edges.distinct())


MIXED_SQL = f"""
parts AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 41 = 0 THEN '' WHEN p_partkey % 43 = 0 THEN 'folder/noend' ELSE 'd' || (p_partkey % 7) || '/f' || (p_partkey % 50) || '.' || ({list(_ENDINGS)})[p_partkey % {len(_ENDINGS)} + 1] END AS f FROM part),
nodes AS (SELECT 'part_' || k AS id, CASE WHEN k % 11 = 0 THEN 'data' WHEN k % 13 = 0 THEN 'str' WHEN k % 17 = 0 THEN '.run()' WHEN k % 19 = 0 THEN 'go()' WHEN k % 23 = 0 THEN string_split(f, '/')[-1] WHEN k % 29 = 0 THEN f ELSE p_name END AS label,
'code' AS file_type, f AS source_file, (k % 6)::INTEGER AS community FROM parts),
edges AS MATERIALIZED (SELECT DISTINCT 'part_' || l_partkey AS src, 'part_' || ((l_partkey * 7 + l_linenumber * l_linenumber) % 300 + 1) AS dst, (['calls', 'imports', 'references', 'uses', 'semantically_similar_to', 'contains', 'calls'])[l_linenumber] AS relation,
CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM lineitem)
"""


def dialogue(spark: SparkSession, d: str) -> Graph:
    """Turns, each leading to the next one of its conversation."""
    t = table(spark, d, "conversations")
    name = lambda turn: F.format_string("t%08d_%06d", F.col("conv_id"), turn)
    nodes = t.select(name(F.col("turn")).alias("id"), F.col("text").alias("label"), F.lit("document").alias("file_type"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source_file"), F.lit(None).cast("int").alias("community"))
    later = t.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"))
    edges = t.join(later, (F.col("conv_id") == F.col("c2")) & (F.col("turn") + 1 == F.col("t2"))).select(name(F.col("turn")).alias("src"), name(F.col("turn") + 1).alias("dst"), F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit("call").alias("context"))
    return Graph(nodes, edges.distinct())


DIALOGUE_SQL = """
turns AS (SELECT conv_id, turn, printf('t%08d_%06d', conv_id, turn) AS id FROM conversations),
links AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)
"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """A feedback log from events: a record uses the event's type and, for even ids, `references` too."""
    e = table(spark, d, "events")
    kinds = F.array(F.lit("imports"), F.lit("calls"), F.lit("references"), F.lit("uses"), F.lit("contains"))
    first = kinds[F.pmod(F.length("event_type"), F.lit(5)).cast("int")]
    relations = F.when(F.col("event_id") % 2 == 0, F.array(first, F.lit("references"), first)).otherwise(F.array(first))
    return e.select(
        (F.col("value") > 50).alias("useful"),
        F.when(F.col("event_id") % 17 != 0, relations).alias("relations"),
        F.when(F.col("event_id") % 23 == 0, "benchmark").otherwise("user").alias("source"),
        (F.col("event_id") % 10 == 0).alias("held_out"),
    )


FEEDBACK_SQL = """
log AS (SELECT value > 50 AS useful, CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN [f, 'references', f] ELSE [f] END END AS relations,
CASE WHEN event_id % 23 = 0 THEN 'benchmark' ELSE 'user' END AS source, event_id % 10 = 0 AS held_out
FROM (SELECT *, (['imports', 'calls', 'references', 'uses', 'contains'])[length(event_type) % 5 + 1] AS f FROM events))
"""


def memory_docs(spark: SparkSession, d: str) -> DataFrame:
    """Dated outcomes from events: which users an answer drew on, and whether that was useful."""
    e = table(spark, d, "events")
    outcome = F.when(F.col("value") > 60, "useful").when(F.col("value") > 30, "dead_end").otherwise("corrected")
    return e.select(
        F.col("event_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("q"), (F.col("event_id") % 500).cast("string")).alias("question"),
        outcome.alias("outcome"),
        F.array(F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.concat(F.lit("type_"), "event_type")).alias("source_nodes"),
    )


MEMORY_SQL = """
docs AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, 'q' || (event_id % 500) AS question, CASE WHEN value > 60 THEN 'useful' WHEN value > 30 THEN 'dead_end' ELSE 'corrected' END AS outcome,
['user_' || user_id, 'type_' || event_type] AS source_nodes FROM events)
"""
