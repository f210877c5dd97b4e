"""Registered queries: rankings, explanations, excerpts, reviews, overlays, what models say, scans and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, claims, graph, learn, retrieval, semantic
from ..sources import extract, graphs, scan, testgraph
from ..sources.storage import table
from ..sources.testgraph import FEEDBACK_SQL, MEMORY_SQL, MIXED_SQL, TRADE_SQL
from .catalogue import CANDIDATES, DEG, IMP, longs, query

TRADE, MIXED = "WITH " + TRADE_SQL, "WITH " + MIXED_SQL


def _num(p: str, c):
    return F.concat(F.lit(p), c.cast("string"))


# ---- rankings and explanations ----

NEAR = f"""{DEG}, c AS (SELECT 'out' AS direction, dst AS id, relation, confidence FROM edges WHERE src = 'part_1' UNION ALL SELECT 'in', src, relation, confidence FROM edges WHERE dst = 'part_1'),
r AS (SELECT row_number() OVER (ORDER BY degree DESC, c.id, direction, relation, confidence) AS place, c.*, degree, source_file FROM c JOIN deg ON deg.id = c.id LEFT JOIN nodes ON nodes.id = c.id)"""


@query(TRADE + f", {NEAR} SELECT place, direction, id, relation, confidence, degree FROM r WHERE place <= 20")
def explain_node(spark, d):
    g = testgraph.trade(spark, d)
    return answers.explain(g.nodes, g.edges, "part_1")[0]


@query(TRADE + f", {NEAR} SELECT direction, coalesce(source_file, '(unknown file)') AS source_file, count(*) AS n FROM r WHERE place > 20 GROUP BY 1, 2 ORDER BY n DESC, direction, source_file LIMIT 20")
def explain_rest_by_file(spark, d):
    g = testgraph.trade(spark, d)
    return answers.explain(g.nodes, g.edges, "part_1")[1]


@query(
    """WITH s AS (SELECT 'part_' || p_partkey AS id, p_name AS label, (p_size % 17)::DOUBLE AS score, string_split(lower(p_name), ' ') AS w FROM part)
SELECT id, label, score FROM s ORDER BY list_contains(w, 'red') AND list_contains(w, 'bolt') DESC, score DESC, length(label), id LIMIT 1"""
)
def endpoint_pick(spark, d):
    s = table(spark, d, "part").select(_num("part_", F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"), (F.col("p_size") % 17).cast("double").alias("score"))
    return answers.endpoint(s, "bolt Red")


@query(TRADE + f" SELECT src, dst, relation, round({IMP}, 6) AS importance FROM edges WHERE src LIKE 'customer_1%' ORDER BY {IMP} DESC, src || dst LIMIT 50")
def edge_ranking(spark, d):
    e = testgraph.trade(spark, d).edges.filter("src LIKE 'customer_1%'").withColumn("seq", F.concat("src", "dst"))
    return answers.rank_edges(e, 50).select("src", "dst", "relation", F.round("importance", 6).alias("importance"))


@query("""WITH s AS (SELECT 'part_' || p_partkey AS id, (p_size % 11)::DOUBLE AS score FROM part), o AS (SELECT *, CASE id WHEN 'part_9' THEN 1 WHEN 'part_4' THEN 2 ELSE 3 END AS k FROM s)
SELECT row_number() OVER (ORDER BY k, score DESC, id) AS place, id, score FROM o ORDER BY place LIMIT 40""")
def score_ranking(spark, d):
    s = table(spark, d, "part").select(_num("part_", F.col("p_partkey")).alias("id"), (F.col("p_size") % 11).cast("double").alias("score"))
    return answers.rank_by_score(s, ["part_9", "part_4"])


def _parts(spark, d):
    return table(spark, d, "part").select(_num("part_", F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"), F.concat(F.lit("src/"), "p_brand", F.lit(".py")).alias("source_file"))


_TERMS = ("red", "ring", "brand#3")


def _term_sql() -> str:
    w = ", ".join(f"ln(1 + count(*) / (1 + count(*) FILTER (contains(l, '{t}')))) AS w{k}" for k, t in enumerate(_TERMS))
    one = lambda k, t: f"""SELECT '{t}' AS term, id, label, degree, w{k} * (CASE WHEN l = '{t}' OR b = '{t}' OR words = '{t}' OR lower(id) = '{t}' THEN 10000 WHEN starts_with(l, '{t}') OR starts_with(b, '{t}') OR starts_with(words, '{t}') THEN 1000 ELSE 0 END
 + CASE WHEN l = '{t}' OR b = '{t}' THEN 1000 WHEN starts_with(l, '{t}') OR starts_with(b, '{t}') THEN 100 WHEN contains(l, '{t}') THEN 1 ELSE 0 END + CASE WHEN contains(f, '{t}') THEN 0.5 ELSE 0 END) AS score FROM n, w"""  # noqa: E731
    return f"""WITH e AS (SELECT 'part_' || l_partkey AS src, 's_' || l_suppkey AS dst FROM lineitem), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
n AS (SELECT 'part_' || p_partkey AS id, p_name AS label, lower(p_name) AS l, regexp_replace(lower(p_name), '[()]+$', '') AS b, array_to_string(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS words, lower('src/' || p_brand || '.py') AS f, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON d.id = 'part_' || p_partkey),
w AS (SELECT {w} FROM n), s AS ({" UNION ALL ".join(one(k, t) for k, t in enumerate(_TERMS))}) SELECT term, id, label FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, degree DESC, length(label), id) = 1"""


@query(_term_sql())
def best_seed_per_term(spark, d):
    e = table(spark, d, "lineitem").select(_num("part_", F.col("l_partkey")).alias("src"), _num("s_", F.col("l_suppkey")).alias("dst"))
    return retrieval.term_seeds(_parts(spark, d), e, list(_TERMS))


# ---- excerpts and chunks ----

SYMBOLS = "s AS (SELECT 'f' || (l_orderkey % 500) AS source_file, (l_partkey * 7 % 400 + 1)::BIGINT AS line, 300::BIGINT AS n_lines FROM lineitem)"


def _symbols(spark, d):
    return table(spark, d, "lineitem").select(_num("f", F.col("l_orderkey") % 500).alias("source_file"), (F.col("l_partkey") * 7 % 400 + 1).alias("line"), F.lit(300).cast("long").alias("n_lines"))


@query(f"WITH {SYMBOLS}, t AS (SELECT DISTINCT * FROM s WHERE line <= n_lines) SELECT source_file, line, greatest(line, least(coalesce(lead(line) OVER (PARTITION BY source_file ORDER BY line) - 1, n_lines), n_lines, line + 79)) AS \"end\" FROM t")
def excerpt_ends(spark, d):
    return answers.excerpt_ends(_symbols(spark, d))


@query(
    """WITH r AS (SELECT 'f' || (l_partkey % 200) AS source_file, l_orderkey * 10 + l_linenumber AS place, l_suppkey % 50 + 1 AS line, l_suppkey % 50 + 1 + l_quantity::BIGINT AS "end" FROM lineitem)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.source_file = r.source_file AND q.place < r.place AND q.line <= r.line AND r."end" <= q."end")"""
)
def covered_suppression(spark, d):
    line = F.col("l_suppkey") % 50 + 1
    r = table(spark, d, "lineitem").select(_num("f", F.col("l_partkey") % 200).alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), line.alias("line"), (line + F.col("l_quantity").cast("long")).alias("end"))
    return answers.uncovered(r)


@query(
    """WITH RECURSIVE f AS (SELECT p_brand AS repo, 'd' || (p_size % 7) || '/' || p_partkey AS path, p_size * 10 AS t, row_number() OVER (PARTITION BY p_brand ORDER BY 'd' || (p_size % 7) || '/', 'd' || (p_size % 7) || '/' || p_partkey) AS k FROM part),
w AS (SELECT repo, path, k, 0::BIGINT AS chunk, t AS used FROM f WHERE k = 1 UNION ALL SELECT f.repo, f.path, f.k, CASE WHEN used > 0 AND used + t > 900 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + t > 900 THEN t ELSE used + t END FROM w JOIN f ON f.repo = w.repo AND f.k = w.k + 1)
SELECT repo, path, chunk FROM w"""
)
def chunk_packing(spark, d):
    f = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.concat(F.lit("d"), (F.col("p_size") % 7).cast("string"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") * 10).alias("tokens"))
    return answers.pack_chunks(f, 900)


@query("WITH n AS (SELECT 'part_' || p_partkey AS id, p_brand AS f FROM part) SELECT ((row_number() OVER (ORDER BY f, id) - 1) // 16)::BIGINT AS batch, id FROM n")
def code_unit_batches(spark, d):
    n = table(spark, d, "part").select(_num("part_", F.col("p_partkey")).alias("id"), F.col("p_brand").alias("source_file"), F.lit("code").alias("file_type"))
    return answers.code_units(n, 16)


# ---- reviews, overlays, repositories ----


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'WRONG-BASE' WHEN o_orderstatus = 'P' THEN 'CI-FAIL' WHEN o_orderpriority = '1-URGENT' THEN 'CHANGES-REQ' WHEN o_orderkey % 5 = 0 THEN 'DRAFT' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') >= 14 THEN 'STALE'
WHEN o_orderpriority = '5-LOW' THEN 'APPROVED' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'READY' END AS status FROM orders"""
)
def review_status(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "old").otherwise("main").alias("base_branch"), F.when(F.col("o_orderstatus") == "P", "FAILURE").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("SUCCESS").alias("ci_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CHANGES_REQUESTED").when(F.col("o_orderpriority") == "5-LOW", "APPROVED").alias("review_decision"), (F.col("o_orderkey") % 5 == 0).alias("is_draft"), F.to_date("o_orderdate").alias("updated_at"),
    )
    return o.select("id", answers.review_status("main", F.lit("1998-08-02").cast("date")).alias("status"))


@query("WITH t AS (SELECT DISTINCT l_suppkey AS change, l_partkey AS community FROM lineitem) SELECT x.change AS a, y.change AS b, count(*) AS shared FROM t x JOIN t y USING (community) WHERE x.change < y.change GROUP BY 1, 2")
def review_conflicts(spark, d):
    return answers.review_conflicts(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("change"), F.col("l_partkey").alias("community")))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN 'preferred' END AS status, CASE WHEN p_size > 20 THEN p_size ELSE 0 END::BIGINT AS uses, p_size > 20 AND p_size % 2 = 0 AS stale FROM part")
def learning_overlay(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("hash"))
    then = F.when(F.col("p_size") % 2 == 0, F.md5(F.concat("p_name", F.lit("x")))).otherwise(F.md5("p_name"))
    return answers.overlay(nodes, p.filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.lit("preferred").alias("status"), F.col("p_size").alias("uses"), then.alias("hash")))


@query(f"""WITH {FEEDBACK_SQL}, u AS (SELECT useful, unnest(list_distinct(relations)) AS relation FROM log WHERE NOT held_out AND useful IS NOT NULL AND len(relations) > 0 AND source <> 'benchmark'),
p(relation, prior) AS (VALUES ('imports', 0.4), ('calls', 1.0), ('references', 0.6), ('uses', 0.7), ('contains', 0.75)), n AS (SELECT relation, count(*) AS e, sum(useful::INT) AS k FROM u GROUP BY 1)
SELECT p.relation, round(CASE WHEN e >= 3 THEN least(1.0, greatest(0.05, (prior * 8 + k) / (8.0 + e))) ELSE prior END, 6)::DOUBLE AS importance FROM p LEFT JOIN n USING (relation)""")
def learned_registry(spark, d):
    relations = spark.createDataFrame([(x,) for x in ("imports", "calls", "references", "uses", "contains")], "relation string")
    return answers.learned_registry(relations, learn.learned_weights(testgraph.feedback(spark, d))).withColumn("importance", F.round("importance", 6))


@query("""WITH n AS (SELECT 'a' || p_partkey AS id, p_type AS label FROM part WHERE p_size < 25), k AS (SELECT 'b' || p_partkey AS id, p_type AS label FROM part WHERE p_size >= 25 AND p_size % 2 = 0), m AS (SELECT label, min(id) AS existing FROM k GROUP BY 1)
SELECT id, existing FROM n JOIN m USING (label)""")
def external_join(spark, d):
    p = table(spark, d, "part")
    file = F.when(F.col("p_size") % 2 == 1, "f.py").otherwise("")
    known = p.filter("p_size >= 25").select(_num("b", F.col("p_partkey")).alias("id"), F.col("p_type").alias("label"), file.alias("source_file"))
    return answers.join_externals(p.filter("p_size < 25").select(_num("a", F.col("p_partkey")).alias("id"), F.col("p_type").alias("label"), F.lit(None).cast("string").alias("source_file")), known)


@query("SELECT p_partkey AS id, p_name AS label, p_brand AS repo FROM part WHERE p_brand <> 'Brand#2' UNION ALL SELECT p_partkey, 'new', 'Brand#2' FROM part WHERE p_size = 7")
def repository_replace(spark, d):
    p = table(spark, d, "part")
    known = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("repo"))
    return answers.replace_repo(known, "Brand#2", p.filter("p_size = 7").select(F.col("p_partkey").alias("id"), F.lit("new").alias("label")))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 30 THEN p_name ELSE p_type END AS label FROM part")
def merge_chunks(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_size < 30").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit(0).alias("seq"))
    return graph.first_wins(a.union(p.filter("p_size > 10").select(F.col("p_partkey"), F.col("p_type"), F.lit(1))), ["id"]).drop("seq")


@query(TRADE + f", {DEG}, a AS (SELECT n.id, coalesce(degree, 0)::BIGINT AS degree, row_number() OVER (ORDER BY coalesce(degree, 0)) - 1 AS k FROM nodes n LEFT JOIN deg ON deg.id = n.id) SELECT id, degree FROM a WHERE degree > (SELECT degree FROM a WHERE k = greatest(0, floor((SELECT count(*) FROM a) * 95 / 100)::BIGINT - 1))")
def hub_percentile(spark, d):
    g = testgraph.trade(spark, d)
    return longs(answers.hub_percentile(g.nodes, g.edges, 95), "degree")


@query()
def distinct_neighbours(spark, d):
    return answers.distinct_neighbours(testgraph.trade(spark, d).edges)


@query("WITH u AS (SELECT event_type AS backend, event_id * 1000 AS i, event_id * 10 AS o FROM events) SELECT backend, i AS input_tokens, o AS output_tokens, round(CASE backend WHEN 'view' THEN i * 0.5 / 1e6 + o * 1.5 / 1e6 WHEN 'click' THEN i * 3.0 / 1e6 + o * 15.0 / 1e6 ELSE 0.0 END, 6) AS cost FROM u")
def cost_estimates(spark, d):
    u = table(spark, d, "events").select(F.col("event_type").alias("backend"), (F.col("event_id") * 1000).alias("input_tokens"), (F.col("event_id") * 10).alias("output_tokens"))
    prices = spark.createDataFrame([("view", 0.5, 1.5), ("click", 3.0, 15.0)], "backend string, input double, output double")
    return answers.cost_estimate(u, prices).withColumn("cost", F.round("cost", 6))


@query()
def betweenness_dialogue(spark, d):
    g = testgraph.dialogue(spark, d)
    return answers.betweenness(g.nodes, g.edges).withColumn("score", F.round("score", 6))


@query(MIXED + f", names(name) AS (VALUES ('part_7'), ('DATA'), ('d3/f24.json'), ('f9.go'), ('run'), ('go()'), ('x/str'), ('part_1'), ('f1'), ('.py'), ('z'), ('re'), ('no such thing')), {CANDIDATES} SELECT name, id, tier::BIGINT AS tier, place FROM cand")
def resolve_nodes(spark, d):
    names = spark.createDataFrame([(x,) for x in ("part_7", "DATA", "d3/f24.json", "f9.go", "run", "go()", "x/str", "part_1", "f1", ".py", "z", "re", "no such thing")], "name string")
    return longs(claims.candidates(names, testgraph.mixed(spark, d).nodes), "tier", "place")


# ---- what models say ----


def _responses(spark, d):
    """Responses of a model about parts: JSON in fences, after words, or broken; ends that are nodes, nearly nodes, or none."""
    k = F.col("p_partkey")
    source = F.when(k % 3 == 0, _num("part_", k)).when(k % 3 == 1, _num(" Part ", k)).otherwise(_num("Idea ", k % 10))
    target = F.when(k % 7 == 0, source).otherwise(_num("part_", k % 50 + 1))
    kind = F.array(*map(F.lit, ("handles", "Manages ", "calls", "related_to")))[(k % 4).cast("int")]
    json = F.to_json(F.struct(F.array(F.struct(source.alias("source"), target.alias("target"), kind.alias("relation"), F.when(k % 2 == 0, "extracted").otherwise("sure").alias("confidence"), F.lit("why").alias("rationale"))).alias("relations")))
    text = F.when(k % 5 == 0, F.concat(F.lit("Here it is:\n```json\n"), json, F.lit("\n```\nThat is all."))).when(k % 5 == 1, json).when(k % 5 == 2, F.concat(F.lit("I say "), json)).when(k % 5 == 3, F.concat(json, F.lit(" and more"))).otherwise(F.lit("nothing"))
    return table(spark, d, "part").select(k.alias("response_id"), text.alias("text"))


SAID = """p AS (SELECT p_partkey AS k FROM part), raw AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'part_' || k WHEN k % 3 = 1 THEN 'Part ' || k ELSE 'Idea ' || (k % 10) END AS s, (['handles', 'manages', 'calls', 'related_to'])[k % 4 + 1] AS relation, CASE WHEN k % 2 = 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM p WHERE k % 5 < 3),
r AS (SELECT k AS response_id, 0::BIGINT AS place, CASE WHEN k % 3 = 2 THEN 'concept_' || replace(lower(s), ' ', '_') ELSE 'part_' || k END AS src, relation, 'part_' || (k % 50 + 1) AS dst, confidence, 'why' AS rationale FROM raw WHERE relation <> 'calls' AND k % 7 <> 0),
rel AS (SELECT * FROM r WHERE src <> dst)"""


@query(f"WITH {SAID} SELECT * FROM rel")
def semantic_relations(spark, d):
    nodes = table(spark, d, "part").select(_num("part_", F.col("p_partkey")).alias("id"))
    return semantic.parse_relations(_responses(spark, d), nodes)[0]


@query(f"WITH {SAID} SELECT src AS id, min('Idea ' || (response_id % 10)) AS label FROM rel WHERE starts_with(src, 'concept_') GROUP BY 1")
def semantic_concepts(spark, d):
    nodes = table(spark, d, "part").select(_num("part_", F.col("p_partkey")).alias("id"))
    return semantic.parse_relations(_responses(spark, d), nodes)[1]


@query(
    """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'imports' AS relation FROM lineitem WHERE l_linenumber = 1),
r AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS src, CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS dst, (['handles', 'manages', 'related_to'])[l_linenumber % 3 + 1] AS relation FROM lineitem),
f AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, relation, min(seq) AS seq, arg_min(src, seq) AS src, arg_min(dst, seq) AS dst FROM r GROUP BY 1, 2, 3),
has AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY seq, relation) AS n, (a, b) IN (SELECT (a, b) FROM has) AS old FROM f),
sec AS (SELECT a, b, string_agg(relation, ',' ORDER BY seq, relation) AS s FROM o WHERE old OR n > 1 GROUP BY 1, 2)
SELECT x.src, x.dst, x.relation, coalesce(s, '') AS secondary FROM (SELECT src, dst, relation FROM e UNION ALL SELECT src, dst, relation FROM o WHERE NOT old AND n = 1) x LEFT JOIN sec ON sec.a = least(x.src, x.dst) AND sec.b = greatest(x.src, x.dst)"""
)
def semantic_apply(spark, d):
    li, k = table(spark, d, "lineitem"), F.col("l_linenumber")
    s, p = _num("s", F.col("l_suppkey")), _num("p", F.col("l_partkey"))
    e = li.filter("l_linenumber = 1").select(s.alias("src"), p.alias("dst"), F.lit("imports").alias("relation")).distinct().withColumn("secondary", F.array().cast("array<string>"))
    kind = F.array(*map(F.lit, ("handles", "manages", "related_to")))[(k % 3).cast("int")]
    r = li.select((F.col("l_orderkey") * 10 + k).alias("seq"), F.when(k % 2 == 0, s).otherwise(p).alias("src"), F.when(k % 2 == 0, p).otherwise(s).alias("dst"), kind.alias("relation"))
    return semantic.apply_relations(e, r).withColumn("secondary", F.array_join("secondary", ","))


@query(
    """WITH p AS (SELECT p_partkey AS k FROM part) SELECT k AS response_id, 0::BIGINT AS place, 'exists' AS type, 'X' || k AS source, NULL::VARCHAR AS target, NULL::VARCHAR AS relation FROM p WHERE k % 3 < 2
UNION ALL SELECT k, 1, 'calls', 'a' || k, 'b', CASE WHEN k % 2 = 0 THEN 'indirect_call' END FROM p WHERE k % 3 < 2 UNION ALL SELECT k, 2, 'method_of', 'Own', 'm' || k, NULL FROM p WHERE k % 3 < 2
UNION ALL SELECT k, 3, 'relation', 's', 't', 'manages' FROM p WHERE k % 3 < 2"""
)
def claims_in_text(spark, d):
    k = F.col("p_partkey")
    n = k.cast("string")
    second = F.when(k % 2 == 0, F.concat(F.lit('{"type": "indirect_call", "source": "a'), n, F.lit('", "target": "b"}'))).otherwise(F.concat(F.lit('{"claim_type": "Calls", "caller": "a'), n, F.lit('", "callee": "b"}')))
    listed = F.concat(F.lit('[{"type": "exists", "symbol": "X'), n, F.lit('"}, '), second, F.lit(', {"type": "method_of", "owner": "Own", "method": "m'), n, F.lit('"}, {"type": "manages", "source": "s", "target": "t"}, {"type": "calls", "source": "lone"}]'))
    text = F.when(k % 3 == 0, F.concat(F.lit("```\n"), listed, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit('So: {"claims": '), listed, F.lit("}"))).otherwise("no claims {")
    return semantic.parse_claims(table(spark, d, "part").select(k.alias("response_id"), text.alias("text")))


@query("SELECT l_orderkey AS proposal, CASE WHEN bool_or(l_quantity > 45) THEN 'CONTRADICTED' WHEN bool_and(l_quantity > 10) THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS verdict, bool_or(l_quantity > 45) AS blocked FROM lineitem GROUP BY 1")
def proposal_verdicts(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("proposal"), F.when(F.col("l_quantity") > 45, "CONTRADICTED").when(F.col("l_quantity") > 10, "SUPPORTED").otherwise("UNKNOWN").alias("verdict"))
    return semantic.proposal_verdicts(v, strict=True)


# ---- scans and files ----


def _tree(spark, d):
    k = F.col("p_partkey")
    folder = F.array(*map(F.lit, ("src/app", "node_modules/x", "docs", "src/my_venv/lib", ".ssh", "build", "src/.gen/worktrees/a", "secrets", "logs/deep")))[(k % 9).cast("int")]
    name = F.array(*map(F.lit, ("main.py", "notes.md", "yarn.lock", "script", "api_token.json", "keep.log", "a.log")))[(k % 7).cast("int")]
    text = F.when(k % 7 == 3, F.concat(F.lit("#!/usr/bin/env python3\n"), "p_name")).when(k % 14 == 1, F.concat(F.lit("abstract: we propose, in the proceedings "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.concat(folder, F.lit("/"), k.cast("string"), F.lit("/"), name).alias("path"), text.alias("text"))


_RULES = [("", "# comment"), ("", "*.log"), ("", "!keep.log"), ("", "docs/"), ("src", "/app/1*"), ("", "src/**/main.py"), ("src/app", "!main.py")]
TREE = """t AS (SELECT p_partkey AS k, (['src/app', 'node_modules/x', 'docs', 'src/my_venv/lib', '.ssh', 'build', 'src/.gen/worktrees/a', 'secrets', 'logs/deep'])[p_partkey % 9 + 1] AS folder, (['main.py', 'notes.md', 'yarn.lock', 'script', 'api_token.json', 'keep.log', 'a.log'])[p_partkey % 7 + 1] AS name, p_name FROM part),
ig AS (SELECT *, folder || '/' || k || '/' || name AS path, folder = 'docs' OR (folder = 'src/app' AND starts_with(k::VARCHAR, '1')) OR name = 'a.log' OR (name = 'main.py' AND starts_with(folder, 'src/') AND folder <> 'src/app') AS ignored FROM t)"""


@query(f"WITH {TREE} SELECT path, ignored FROM ig")
def ignore_rules(spark, d):
    return _tree(spark, d).select("path", scan.is_ignored(F.col("path"), _RULES).alias("ignored"))


@query(
    f"""WITH {TREE}, kept AS (SELECT *, name = 'api_token.json' OR folder = '.ssh' OR (folder = 'secrets' AND name <> 'main.py') AS secret, len(regexp_extract_all(p_name, '\\S+')) AS w FROM ig WHERE NOT ignored AND folder IN ('src/app', '.ssh', 'secrets', 'logs/deep') AND name <> 'yarn.lock'),
c AS (SELECT path, CASE name WHEN 'main.py' THEN 'code' WHEN 'script' THEN 'code' WHEN 'notes.md' THEN CASE WHEN k % 14 = 1 THEN 'paper' ELSE 'document' END END AS kind, CASE WHEN secret THEN 0 WHEN k % 7 = 3 THEN w + 2 WHEN k % 14 = 1 THEN w + 6 ELSE w END::BIGINT AS words, secret FROM kept) SELECT * FROM c WHERE kind IS NOT NULL"""
)
def directory_scan(spark, d):
    return scan.counted(_tree(spark, d), _RULES)


@query(f"WITH {TREE}, w AS (SELECT count(*) AS files, coalesce(sum(len(regexp_extract_all(p_name, '\\S+'))), 0)::BIGINT AS words FROM t WHERE folder = 'src/app' AND name IN ('main.py')) SELECT files, words, CASE WHEN words >= 500000 OR files >= 500 THEN 'large' WHEN words < 50000 THEN 'fits' ELSE 'medium' END AS verdict FROM w")
def scan_verdict(spark, d):
    return scan.scan_verdict(scan.counted(_tree(spark, d).filter("path LIKE 'src/app/%/main.py'")))


@query(f"WITH {TREE} SELECT path FROM ig WHERE name = 'main.py' AND folder IN ('src/app', 'docs', '.ssh', 'secrets', 'logs/deep')")
def code_file_listing(spark, d):
    return scan.code_files(_tree(spark, d)).select("path")


_MEMORY_TEXT = "'---' || chr(10) || 'type: \"query\"' || chr(10) || 'date: \"' || date || '\"' || chr(10) || 'question: \"' || question || '\"' || chr(10) || 'outcome: \"' || outcome || '\"' || chr(10) || 'source_nodes: [\"' || array_to_string(source_nodes, '\", \"') || '\"]' || chr(10) || '---' || chr(10) || chr(10) || 'answer ' || event_id"


def _memory(spark, d):
    return graphs.memory_text(testgraph.memory_docs(spark, d).select(_num("m", F.col("event_id")).alias("path"), "date", "question", _num("answer ", F.col("event_id")).alias("answer"), "outcome", "source_nodes"))


@query(f"WITH {MEMORY_SQL} SELECT 'm' || event_id AS path, {_MEMORY_TEXT} AS text FROM docs")
def memory_documents(spark, d):
    return _memory(spark, d)


@query(f"WITH {MEMORY_SQL} SELECT 'm' || event_id AS path, 'query' AS type, date, question, outcome, '' AS correction, array_to_string(source_nodes, ',') AS source_nodes FROM docs")
def memory_scan(spark, d):
    return graphs.memory_fields(_memory(spark, d)).withColumn("source_nodes", F.array_join("source_nodes", ","))


_XML = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    f"""WITH {MIXED_SQL} SELECT 1 AS place, '<node id="' || {_XML('id')} || '"><data key="label">' || {_XML('label')} || '</data><data key="source_file">' || {_XML('source_file')} || '</data></node>' AS line FROM nodes
UNION ALL SELECT 2, '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || relation || '</data></edge>' FROM edges"""
)
def graphml_lines(spark, d):
    g = testgraph.mixed(spark, d)
    return graphs.graphml(g.nodes.select("id", "label", "source_file", F.lit(1).alias("_x")), g.edges.select("src", "dst", "relation")).filter("place IN (1, 2)")


@query(
    r"""WITH t AS (SELECT doc_id, 'See [a](x' || (doc_id % 5) || '.md#top), [b](https://h.org/y.md) and [c](#here).' || chr(10) || '```' || chr(10) || '[d](no.md)' || chr(10) || '```' || chr(10) || '[e](sub/z.md "title")' AS text FROM documents)
SELECT doc_id, 'x' || (doc_id % 5) || '.md' AS target FROM t UNION ALL SELECT doc_id, 'sub/z.md' FROM t"""
)
def markdown_links(spark, d):
    x = F.concat(F.lit("See [a](x"), (F.col("doc_id") % 5).cast("string"), F.lit('.md#top), [b](https://h.org/y.md) and [c](#here).\n```\n[d](no.md)\n```\n[e](sub/z.md "title")'))
    return extract.markdown_links(table(spark, d, "documents").select("doc_id", x.alias("text")))


@query(
    """WITH k AS (SELECT DISTINCT p_size AS k FROM part), f AS (SELECT 'f' || k AS path, k::VARCHAR AS k FROM k)
SELECT path, 'table' AS kind, 't' || k AS name, '' AS target FROM f UNION ALL SELECT path, 'references', 't' || k, 'base' FROM f UNION ALL SELECT path, 'references', 't' || k, 's.other' FROM f UNION ALL SELECT path, 'view', 'v' || k, '' FROM f
UNION ALL SELECT path, 'reads_from', 'v' || k, 't' || k FROM f UNION ALL SELECT path, 'reads_from', 'v' || k, 'base' FROM f UNION ALL SELECT path, 'trigger', 'g' || k, '' FROM f UNION ALL SELECT path, 'triggers', 'g' || k, 't' || k FROM f UNION ALL SELECT path, 'function', 'fn' || k, '' FROM f UNION ALL SELECT path, 'reads_from', 'fn' || k, 'base' FROM f"""
)
def sql_ddl(spark, d):
    k = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS T"), k, F.lit(" (a int REFERENCES base(id)); -- references nothing\n/* create view no as select 1 from x */ ALTER TABLE t"), k, F.lit(' ADD FOREIGN KEY (b) REFERENCES "s"."other"(id);\ncreate or replace view V'), k,
        F.lit(" as select * from t"), k, F.lit(" join base on true;\nCREATE TRIGGER g"), k, F.lit(" AFTER INSERT ON t"), k, F.lit(" EXECUTE check();\nCREATE FUNCTION fn"), k, F.lit("() RETURNS int AS 'select count(*) from base' LANGUAGE sql;"),
    )
    return extract.extract_sql(table(spark, d, "part").select(F.concat(F.lit("f"), k).alias("path"), text.alias("text")).distinct())


@query(f"""WITH {TRADE_SQL}, {MEMORY_SQL}, e AS (SELECT unnest(source_nodes) AS node, outcome FROM docs) SELECT node, count(*) FILTER (outcome = 'useful') AS positives, count(*) FILTER (outcome <> 'useful') AS negatives FROM e
WHERE node IN (SELECT 'user_' || c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY node""")
def lessons_of_known_nodes(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(_num("user_", F.col("c_custkey")).alias("id"))
    return learn.lessons(testgraph.memory_docs(spark, d), "2024-02-01", known=known).select("node", "positives", "negatives")


@query(TRADE + """, t AS (SELECT id, label, file_type FROM nodes) SELECT count(*) AS nodes, sum(length(label) // 4)::BIGINT AS tokens FROM t WHERE id IN (SELECT 'part_1' UNION SELECT src FROM edges WHERE dst = 'part_1' UNION SELECT dst FROM edges WHERE src = 'part_1')""")
def neighbourhood_tokens(spark, d):
    g = testgraph.trade(spark, d)
    near = graph.neighbours(g.edges, "part_1").select("id").union(spark.createDataFrame([("part_1",)], "id string")).distinct()
    return g.nodes.join(near, "id", "left_semi").agg(F.count("*").alias("nodes"), F.sum(F.floor(F.length("label") / 4)).alias("tokens"))

