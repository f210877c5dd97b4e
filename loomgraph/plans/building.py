"""Registered queries: building graphs, and rules over nodes of many kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyze, build, graph
from ..sources import testgraph
from ..sources.storage import table
from ..sources.testgraph import MIXED_SQL, TRADE_SQL
from .catalogue import DEG, longs, query

TRADE, MIXED = "WITH " + TRADE_SQL, "WITH " + MIXED_SQL


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


ENDING = r"lower(regexp_extract(source_file, '\.([A-Za-z0-9]+)$', 1))"
NAME = "string_split(source_file, '/')[-1]"
FILE_LABEL = f"(source_file <> '' AND (label = {NAME} OR (contains(label, '/') AND (source_file = label OR ends_with(source_file, '/' || label)))))"
FILE_NODE = f"({FILE_LABEL} OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND coalesce(degree, 0) <= 1))"
CONCEPT = f"(coalesce(source_file, '') = '' OR NOT contains({NAME}, '.'))"
NOISE = f"((ends_with(lower(source_file), '.json') AND lower(trim(label)) IN {_list(graph.JSON_KEYS)}) OR label IN {_list(graph.BUILTINS)})"
FULL = f"{DEG}, facts AS (SELECT n.*, degree, {FILE_NODE} AS is_file, {CONCEPT} AS is_concept, {NOISE} AS is_noise, {_map(graph.FAMILY_OF)}[{ENDING}] AS fam, {_map(analyze.LANGUAGE_OF)}[{ENDING}] AS lang FROM nodes n LEFT JOIN deg ON deg.id = n.id)"


@query(MIXED + f", {FULL} SELECT id, label, degree FROM facts WHERE degree > 0 AND NOT is_file AND NOT is_concept AND NOT is_noise ORDER BY degree DESC, id LIMIT 50")
def god_nodes_mixed(spark, d):
    g = testgraph.mixed(spark, d)
    return graph.god_nodes(g.nodes, g.edges, 50)


@query(MIXED + f", {FULL} SELECT id, is_file, is_concept, is_noise, fam FROM facts")
def node_predicates(spark, d):
    g = testgraph.mixed(spark, d)
    n = g.nodes.join(graph.degrees(g.edges), "id", "left")
    label, path = F.col("label"), F.col("source_file")
    return n.select("id", graph.is_file_node(label, path, F.col("degree")).alias("is_file"), graph.is_concept_node(path).alias("is_concept"), graph.is_noise(label, path).alias("is_noise"), graph.family(path).alias("fam"))


ADMITTED = f"""a AS (SELECT e.* FROM edges e JOIN facts s ON s.id = src JOIN facts t ON t.id = dst
WHERE NOT (coalesce(s.fam <> t.fam, false) AND ((relation = 'calls' AND confidence = 'INFERRED') OR relation IN ('imports', 'imports_from', 'references'))) AND NOT (relation IN ('imports', 'imports_from') AND src = dst)),
admitted AS (SELECT * FROM a WHERE src = dst OR src < dst OR NOT EXISTS (SELECT 1 FROM a b WHERE b.src = a.dst AND b.dst = a.src AND b.relation = a.relation))"""


@query(MIXED + f", {FULL}, {ADMITTED} SELECT src, dst, relation, confidence FROM admitted")
def edge_admission_mixed(spark, d):
    g = testgraph.mixed(spark, d)
    return graph.admit(g.nodes, g.edges).select("src", "dst", "relation", "confidence")


@query(MIXED + f", {FULL}, {ADMITTED} SELECT src, dst, relation, confidence FROM admitted QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src DESC, dst DESC, relation DESC, confidence DESC) = 1")
def one_edge_a_pair(spark, d):
    g = testgraph.mixed(spark, d)
    return build.one_edge_a_pair(graph.admit(g.nodes, g.edges).select("src", "dst", "relation", "confidence"))


CATEGORY = "CASE WHEN {0} IN ('py', 'js', 'ts', 'java', 'go', 'rs', 'c', 'cpp', 'cs', 'rb', 'kt', 'scala', 'php', 'swift', 'sql', 'sh') THEN 'code' WHEN {0} = 'pdf' THEN 'paper' WHEN {0} IN ('png', 'jpg', 'jpeg', 'gif', 'svg', 'webp') THEN 'image' ELSE 'doc' END"


@query(
    MIXED
    + f""", {FULL}, f AS (SELECT *, {CATEGORY.format(ENDING)} AS cat, string_split(source_file, '/')[1] AS top FROM facts),
p AS (SELECT src, dst, relation, confidence, least(s.degree, t.degree) AS low, greatest(s.degree, t.degree) AS high, CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END AS sure,
s.cat <> t.cat AS kinds, s.top <> t.top AS tops, s.community <> t.community AS comms,
confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(s.lang <> t.lang, false) OR (s.cat = 'code' AND t.cat = 'doc') OR (s.cat = 'doc' AND t.cat = 'code')) AS weak
FROM edges JOIN f s ON s.id = src JOIN f t ON t.id = dst WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND NOT s.is_file AND NOT t.is_file AND NOT s.is_concept AND NOT t.is_concept AND s.source_file <> t.source_file),
q AS (SELECT *, CASE WHEN weak THEN 0 ELSE sure + 2 * kinds::INT + 2 * tops::INT + comms::INT END AS base FROM p)
SELECT src, dst, relation, confidence, (CASE WHEN relation = 'semantically_similar_to' THEN floor(base * 1.5) ELSE base END + (low <= 2 AND high >= 5)::INT)::BIGINT AS score FROM q"""
)
def surprise_scores_mixed(spark, d):
    g = testgraph.mixed(spark, d)
    return analyze.surprises(g.nodes, g.edges)


# Fragments of parts and lines with old names of fields, Windows paths, odd types and twins.
def _fragments(spark, d):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("part_"), c.cast("string"))
    path = F.concat(F.when(k % 4 == 0, "/work/repo\\").otherwise(""), F.lit("d"), (k % 5).cast("string"), F.when(k % 3 == 0, "\\").otherwise("/"), F.lit("f.md"))
    kinds = F.array(*map(F.lit, ("markdown", "code", "tool", "concept", "gotcha", "document")))
    p = table(spark, d, "part")
    plain = p.select(
        F.lit(0).alias("seq"), name(k).alias("id"), F.when(k % 6 != 0, F.col("p_name")).alias("label"), F.concat(F.lit("alias "), "p_name").alias("name"), F.when(k % 7 != 0, path).otherwise("").alias("source_file"), path.alias("path"), kinds[(k % 6).cast("int")].alias("file_type")
    )
    again = plain.filter("id LIKE '%5'").withColumns({"seq": F.lit(1), "label": F.lit("again")})
    twins = plain.filter("file_type IN ('markdown', 'document') AND id LIKE '%2'").withColumns({"seq": F.lit(2), "id": F.concat("id", F.lit("_doc")), "source_file": F.col("path")})
    line = table(spark, d, "lineitem")
    other = name((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 400 + 1)
    edges = line.select(
        name(F.col("l_partkey")).alias("src"), other.alias("dst"), F.when(F.col("l_linenumber") % 3 != 0, "calls").alias("relation"), F.lit("references").alias("type"),
        F.when(F.col("l_linenumber") % 4 != 0, "EXTRACTED").alias("confidence"), F.when(F.col("l_linenumber") % 4 == 0, F.lit(0.9)).alias("confidence_score"),
    ).distinct()
    return plain.unionByName(again).unionByName(twins), edges


FRAGMENTS = f"""WITH p AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN '/work/repo\\' ELSE '' END || 'd' || (p_partkey % 5) || CASE WHEN p_partkey % 3 = 0 THEN '\\' ELSE '/' END || 'f.md' AS path FROM part),
plain AS (SELECT 0 AS seq, 'part_' || k AS id, CASE WHEN k % 6 <> 0 THEN p_name END AS label, 'alias ' || p_name AS name, CASE WHEN k % 7 <> 0 THEN path ELSE '' END AS source_file, path, (['markdown', 'code', 'tool', 'concept', 'gotcha', 'document'])[k % 6 + 1] AS file_type FROM p),
raw AS (SELECT * FROM plain UNION ALL SELECT 1, id, 'again', name, source_file, path, file_type FROM plain WHERE id LIKE '%5' UNION ALL SELECT 2, id || '_doc', label, name, path, path, file_type FROM plain WHERE file_type IN ('markdown', 'document') AND id LIKE '%2'),
folded AS (SELECT seq, id, CASE WHEN coalesce(label, '') = '' THEN name ELSE label END AS label, replace(CASE WHEN coalesce(source_file, '') = '' THEN path ELSE source_file END, '\\', '/') AS sf, coalesce({_map(build.TYPE_SYNONYMS)}[lower(file_type)], file_type) AS file_type FROM raw),
normal AS (SELECT seq, id, label, CASE WHEN starts_with(sf, '/work/repo/') THEN sf[12:] ELSE sf END AS source_file, file_type FROM folded),
links AS (SELECT DISTINCT 'part_' || l_partkey AS src, 'part_' || ((l_partkey * 3 + l_linenumber) % 400 + 1) AS dst, CASE WHEN l_linenumber % 3 <> 0 THEN 'calls' ELSE 'references' END AS relation, CASE WHEN l_linenumber % 4 <> 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM lineitem)"""


@query(FRAGMENTS + " SELECT seq, id, label, source_file, file_type FROM normal")
def alias_folding(spark, d):
    n = build.fold_node_aliases(_fragments(spark, d)[0])
    return n.select("seq", "id", "label", build.norm_path(F.col("source_file"), "/work/repo").alias("source_file"), build.file_type(F.col("file_type")).alias("file_type"))


@query(FRAGMENTS + " SELECT src, dst, relation, confidence FROM links")
def edge_alias_folding(spark, d):
    return build.fold_edge_aliases(_fragments(spark, d)[1]).select("src", "dst", "relation", "confidence").distinct()


BUILT = f"""{FRAGMENTS}, one AS (SELECT * FROM normal QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
twin AS (SELECT x.id, y.id AS twin FROM one x JOIN one y ON y.id = x.id || '_doc' AND x.source_file = y.source_file WHERE x.file_type = 'document' AND y.file_type = 'document' AND x.source_file <> ''),
nodes AS (SELECT id, label, file_type, source_file FROM one WHERE id NOT IN (SELECT id FROM twin)),
e1 AS (SELECT DISTINCT coalesce(a.twin, src) AS src, coalesce(b.twin, dst) AS dst, relation, confidence FROM links LEFT JOIN twin a ON a.id = src LEFT JOIN twin b ON b.id = dst),
a AS (SELECT * FROM e1 WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
b AS (SELECT * FROM a WHERE src < dst OR NOT EXISTS (SELECT 1 FROM a r WHERE r.src = a.dst AND r.dst = a.src AND r.relation = a.relation))"""


@query(BUILT + " SELECT src, dst, relation, confidence FROM b QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src DESC, dst DESC, relation DESC, confidence DESC) = 1")
def build_fragments_edges(spark, d):
    return build.build(*_fragments(spark, d), "/work/repo")[1]


@query(BUILT + " SELECT id, label, file_type, source_file FROM nodes")
def build_fragments(spark, d):
    return build.build(*_fragments(spark, d), "/work/repo")[0].select("id", "label", "file_type", "source_file")


@query(BUILT + " SELECT id, twin FROM twin")
def doc_twin_remap(spark, d):
    n = build.fold_node_aliases(_fragments(spark, d)[0])
    n = n.withColumns({"source_file": build.norm_path(F.col("source_file"), "/work/repo"), "file_type": build.file_type(F.col("file_type"))})
    return build.doc_twins(graph.last_wins(n.select("seq", "id", "label", "file_type", "source_file"), ["id"]))


@query(
    """WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 30000000 ELSE 100 END AS bytes, p_partkey % 4 = 0 AS odd, p_partkey % 6 = 0 AS odd_end, p_partkey % 9 = 0 AS wide FROM part WHERE p_size < 10)
SELECT k AS fragment, 'too many bytes' AS problem FROM f WHERE bytes > 26214400 UNION ALL SELECT k, 'bad node id' FROM f WHERE odd UNION ALL SELECT k, 'bad edge end' FROM f WHERE odd_end UNION ALL SELECT k, 'too many members' FROM f WHERE wide"""
)
def fragment_limits(spark, d):
    k = F.col("p_partkey")
    edge = F.struct(F.lit("a").alias("source"), F.when(k % 6 != 0, "b.c:d-e").otherwise("no good").alias("target"))
    wide = F.when(k % 9 == 0, F.array_repeat(F.lit("m"), 257)).otherwise(F.array(F.lit("m")))
    f = table(spark, d, "part").filter("p_size < 10").select(
        k.alias("fragment"), F.when(k % 10 == 0, 30_000_000).otherwise(100).alias("bytes"), F.array(F.lit("ok_1"), F.when(k % 4 == 0, "a b").otherwise("a-b")).alias("nodes"), F.array(edge).alias("edges"), F.array(wide).alias("hyperedges")
    )
    return build.fragment_errors(f)


@query(
    MIXED
    + f""", {FULL}, files AS (SELECT DISTINCT source_file, {NAME} AS name, string_split(source_file, '/') AS parts FROM facts WHERE source_file <> '' AND ({FILE_LABEL})),
many AS (SELECT * FROM files WHERE name IN (SELECT name FROM files GROUP BY name HAVING count(*) > 1)), ends AS (SELECT source_file, k, array_to_string(parts[len(parts) - k + 1:], '/') AS short FROM many, unnest(range(1, len(parts) + 1)) AS u(k)),
alone AS (SELECT *, count(*) OVER (PARTITION BY short) AS n FROM ends), best AS (SELECT source_file, arg_min(short, k) AS short FROM alone WHERE n = 1 GROUP BY source_file)
SELECT id, CASE WHEN ({FILE_LABEL}) AND source_file IN (SELECT source_file FROM many) THEN coalesce((SELECT short FROM best b WHERE b.source_file = facts.source_file), source_file) ELSE label END AS label FROM facts"""
)
def file_node_labels(spark, d):
    return build.relabel_files(testgraph.mixed(spark, d).nodes).select("id", "label")


@query("SELECT p_partkey AS id, CASE WHEN p_size < 30 THEN 'old' ELSE 'new' END AS relation FROM part WHERE p_size < 30 OR p_size > 20")
def hyperedge_union(spark, d):
    p = table(spark, d, "part")
    return build.union_hyperedges(p.filter("p_size < 30").select(F.col("p_partkey").alias("id"), F.lit("old").alias("relation")), p.filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.lit("new").alias("relation")))


@query(
    """WITH m AS (SELECT l_orderkey AS id, 'p' || l_partkey AS node FROM lineitem), k AS (SELECT DISTINCT id, node FROM m WHERE node IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10))
SELECT id, array_to_string(list_sort(list(node)), ',') AS members FROM k GROUP BY id"""
)
def hyperedge_members(spark, d):
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(part).alias("m"))
    odd = F.col("id") % 2 == 1
    h = h.select("id", F.when(odd, F.col("m")).alias("members"), F.when(~odd, F.col("m")).alias("node_ids"))
    known = table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return build.hyperedges_of(h, known).select("id", F.array_join("nodes", ",").alias("members"))


@query(
    """WITH o AS (SELECT p_partkey AS id, p_name AS label FROM part WHERE p_size < 40 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size < 3), n AS (SELECT p_partkey AS id, CASE WHEN p_size = 20 THEN 'x' ELSE p_name END AS label FROM part WHERE p_size < 42),
d AS (SELECT id, label, sum(s) AS n FROM (SELECT *, 1 AS s FROM o UNION ALL SELECT *, -1 FROM n) GROUP BY ALL HAVING sum(s) <> 0) SELECT CASE WHEN n > 0 THEN 'old' ELSE 'new' END AS side, id, label, abs(n)::BIGINT AS n FROM d"""
)
def topology_changes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), "p_size")
    old = p.filter("p_size < 40").union(p.filter("p_size < 3")).drop("p_size").withColumn("community", F.lit(1))
    new = p.filter("p_size < 42").withColumn("label", F.when(F.col("p_size") == 20, "x").otherwise(F.col("label"))).drop("p_size").withColumn("community", F.lit(2))
    return build.topology_changes(old, new)


@query(TRADE + " SELECT DISTINCT source_file FROM nodes WHERE source_file NOT IN (SELECT 'parts/' || p_brand || '/part.py' FROM part) AND source_file NOT LIKE '%customer.py'")
def stale_sources(spark, d):
    n = testgraph.trade(spark, d).nodes
    return build.stale_sources(n, n.filter("source_file LIKE 'parts/%' OR source_file LIKE '%customer.py'").select(F.col("source_file").alias("path")))


@query(
    TRADE
    + """, c AS (SELECT DISTINCT source_file AS path FROM nodes UNION SELECT 'other/' || p_brand FROM part), s AS (SELECT source_file AS path FROM nodes WHERE source_file LIKE '%.py')
SELECT path, CASE WHEN path IN (SELECT path FROM s) THEN 'extract' WHEN path IN (SELECT source_file FROM nodes) THEN 'delete' ELSE 'ignore' END AS change FROM c"""
)
def change_set(spark, d):
    n = testgraph.trade(spark, d).nodes
    changes = n.select(F.col("source_file").alias("path")).union(table(spark, d, "part").select(F.concat(F.lit("other/"), "p_brand")))
    return build.split_changes(changes, n.filter("source_file LIKE '%.py'").select(F.col("source_file").alias("path")), n)


@query(TRADE + """, b AS (SELECT community, list_sort(list(id)) AS m FROM nodes GROUP BY 1), n AS (SELECT community, list_sort(list(id)) AS m FROM nodes WHERE NOT (community = 2 AND file_type = 'concept') GROUP BY 1)
SELECT community, 'c' || community AS label FROM b JOIN n USING (community, m)""")
def kept_community_labels(spark, d):
    n = testgraph.trade(spark, d).nodes
    labels = n.select("community").distinct().withColumn("label", F.concat(F.lit("c"), F.col("community").cast("string")))
    return build.kept_labels(labels, n.select("community", "id"), n.filter("NOT (community = 2 AND file_type = 'concept')").select("community", "id"))


@query(
    TRADE
    + """, c AS (SELECT source_file AS community, count(*) AS size FROM nodes GROUP BY 1), m AS (SELECT community, 100 + length(community) AS new_id FROM c WHERE community LIKE '%.java')
SELECT community, new_id::BIGINT AS new_id FROM m UNION ALL SELECT community, (SELECT max(new_id) FROM m) + row_number() OVER (ORDER BY size DESC, community) FROM c WHERE community NOT IN (SELECT community FROM m)"""
)
def fresh_community_ids(spark, d):
    c = testgraph.trade(spark, d).nodes.groupBy(F.col("source_file").alias("community")).agg(F.count("*").alias("size"))
    return longs(build.relabel_communities(c.filter("community LIKE '%.java'").select("community", (F.lit(100) + F.length("community")).cast("long").alias("new_id")), c), "new_id")


@query(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', '', 'g')[:256] AS label, replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', '', 'g')[:256], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '" + '"' + r"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def sanitized_labels(spark, d):
    label = build.sanitize_label(F.col("text"))
    return table(spark, d, "documents").select("doc_id", label.alias("label"), build.escape_html(label).alias("html"))


@query(TRADE + " SELECT src, dst, relation FROM edges WHERE confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND length(src) % 10 / 10.0 >= 0.85)")
def diagram_edges(spark, d):
    e = testgraph.trade(spark, d).edges.withColumn("confidence_score", (F.length("src") % 10) / 10.0)
    return build.diagram_edges(e).select("src", "dst", "relation")


@query(MIXED + r", k AS (SELECT *, lower(regexp_replace(regexp_replace(trim(label), '^[()]+|[()]+$', '', 'g'), '^\.+', '')) AS key FROM nodes) SELECT id, key, regexp_matches(trim(label), '\.(py|js|ts|tsx|java|go|rs)$') = false AND key <> '' AS symbol FROM k")
def resolvable_symbols(spark, d):
    n = testgraph.mixed(spark, d).nodes
    return n.select("id", build.callable_key(F.col("label")).alias("key"), build.is_symbol(F.col("file_type"), F.col("label")).alias("symbol"))


@query(
    """WITH i AS (SELECT DISTINCT 'f' || (l_suppkey % 20) AS f, 'm' || (l_partkey % 30) AS m, 'n' || l_linenumber AS n FROM lineitem), c AS (SELECT 's' || s_suppkey AS id, 'f' || (s_suppkey % 20) AS f FROM supplier),
t AS (SELECT 'p' || p_partkey AS id, 'm' || (p_partkey % 30) AS m, 'n' || (p_size % 9) AS n FROM part) SELECT DISTINCT c.id AS src, t.id AS dst FROM i JOIN c USING (f) JOIN t USING (m, n)"""
)
def import_class_uses(spark, d):
    num = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    i = table(spark, d, "lineitem").select(num("f", F.col("l_suppkey") % 20).alias("source_file"), num("m", F.col("l_partkey") % 30).alias("module"), num("n", F.col("l_linenumber")).alias("name"))
    c = table(spark, d, "supplier").select(num("s", F.col("s_suppkey")).alias("id"), num("f", F.col("s_suppkey") % 20).alias("source_file"))
    t = table(spark, d, "part").select(num("p", F.col("p_partkey")).alias("id"), num("m", F.col("p_partkey") % 30).alias("module"), num("n", F.col("p_size") % 9).alias("name"))
    return build.import_uses(i, c, t)


_TESTY = "CASE WHEN {0} % 4 = 0 THEN 'tests/a.py' WHEN {0} % 4 = 1 THEN 'src/test_b.py' ELSE 'src/c.py' END"


@query(
    f"""WITH c AS (SELECT DISTINCT l_orderkey AS call_id, {_TESTY.format('l_orderkey')} AS source_file, 'p' || l_partkey AS id, {_TESTY.format('l_partkey')} AS candidate_file FROM lineitem),
t AS (SELECT *, source_file <> 'src/c.py' AS it, candidate_file <> 'src/c.py' AS ot, max((candidate_file <> 'src/c.py')::INT) OVER (PARTITION BY call_id) AS has FROM c) SELECT call_id, source_file, id, candidate_file FROM t WHERE (NOT it AND NOT ot) OR (it AND (ot OR has = 0))"""
)
def call_test_preference(spark, d):
    file = lambda c: F.when(c % 4 == 0, "tests/a.py").when(c % 4 == 1, "src/test_b.py").otherwise("src/c.py")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), file(F.col("l_orderkey")).alias("source_file"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), file(F.col("l_partkey")).alias("candidate_file")).distinct()
    return build.prefer_tests(c)
