"""Operators on small hand-made graphs, with values worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.functions import text as T
from loomgraph.operators import claims, community, dedup, graph, resolution, retrieval, traverse
from loomgraph.sources import extract
from pyspark.sql import functions as F

NODE = "id string, label string, file_type string, source_file string, community int"
EDGE = "src string, dst string, relation string, confidence string, context string"


@pytest.fixture(scope="module")
def diamond(spark):
    nodes = spark.createDataFrame([(x, f"{x}.run()", "code", f"src/{x}.py", k // 2) for k, x in enumerate("ABCDE")], NODE)
    edges = [("A", "B", "calls", "EXTRACTED", "call"), ("B", "D", "calls", "EXTRACTED", "call"), ("A", "C", "imports", "EXTRACTED", None), ("C", "D", "imports", "EXTRACTED", None)]
    return nodes, spark.createDataFrame(edges, EDGE)


def test_paths_and_costs(diamond):
    nodes, edges = diamond
    assert [r["id"] for r in traverse.shortest_path(edges, "A", "D").collect()] == ["A", "B", "D"]
    cost = {r["id"]: r["distance"] for r in traverse.distances(edges, "A").collect()}
    assert cost == {"A": 0, "B": 1, "C": 2.5, "D": 2}
    assert traverse.shortest_path(edges, "A", "E").count() == 0
    near = {r["id"]: (r["distance"], r["parent"]) for r in traverse.expand(nodes, edges, ["A"], 3, weighted=True).collect()}
    assert near == {"A": (0, None), "B": (1, "A"), "C": (1, "A"), "D": (2, "B")}
    assert {r["id"]: r["depth"] for r in traverse.affected(nodes, edges, "D").collect()} == {"B": 1, "C": 1, "A": 2}


def test_pagerank_sums_to_one(diamond):
    nodes, edges = diamond
    scores = {r["id"]: r["score"] for r in traverse.pagerank(nodes, edges, ["A"]).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-6 and scores["B"] > scores["C"] and scores["E"] < 1e-3
    assert traverse.pagerank(nodes, edges, ["nobody"]).count() == 0


def test_importance_with_overrides_and_secondary_relations(spark):
    from loomgraph.functions.weights import clean_number, edge_importance

    d = spark.createDataFrame([("contains", "EXTRACTED", None, []), ("implements", "INFERRED", None, []), ("referenced", "AMBIGUOUS", None, []), ("imports", "EXTRACTED", None, [("handles", "INFERRED")]), ("x", "EXTRACTED", 3.0, []), (None, None, -1.0, [])], "r string, c string, o double, s array<struct<relation:string,confidence:string>>")
    got = [round(r[0], 4) for r in d.select(edge_importance(F.col("r"), F.col("c"), F.col("o"), F.col("s"))).collect()]
    assert got == [0.75, 0.7225, 0.35, 0.5525, 3.0, 0.5]
    n = spark.createDataFrame([("1.5",), ("x",), ("-2",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in n.select(clean_number(F.col("v"))).collect()] == [1.5, 1.0, 1.0, 1.0, 1.0]


def test_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("c", "c")], "a string, b string")
    assert sorted(map(tuple, traverse.file_cycles(p, 5).collect())) == [(1, "c"), (2, "a>b"), (3, "b>c>d")]


def test_communities(spark):
    ids = ["login", "token", "user", "db", "query", "pool"]
    nodes = spark.createDataFrame([(x, x, "code", "s.py", k // 3) for k, x in enumerate(ids)], NODE)
    pairs = [("login", "token"), ("token", "user"), ("login", "user"), ("db", "query"), ("query", "pool"), ("db", "pool"), ("user", "db")]
    edges = spark.createDataFrame([(a, b, "calls", "EXTRACTED", None) for a, b in pairs], EDGE)
    assert {(r["size"], r["cohesion"]) for r in community.cohesion(nodes, edges).collect()} == {(3, 1.0)}
    found = community.louvain(nodes, edges).groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("m")).collect()
    assert sorted(r["m"] for r in found) == [["db", "pool", "query"], ["login", "token", "user"]]
    spread = community.label_propagation(nodes, edges).groupBy("community").count().collect()
    assert sum(r["count"] for r in spread) == 6
    scored = community.scores(nodes, edges, ["login"], ["token"])
    assert community.select(scored, 1)[:2] == ([0], "selected")
    assert community.select(scored.limit(0), 1)[1] == "no_communities"


def test_admission(spark):
    nodes = spark.createDataFrame([("a", "a", "code", "x.py", 0), ("b", "b", "code", "y.go", 0), ("c", "c", "code", "z.py", 0)], NODE)
    edges = spark.createDataFrame([("a", "b", "calls", "INFERRED", None), ("a", "b", "calls", "EXTRACTED", None), ("a", "c", "imports", "EXTRACTED", None), ("c", "a", "imports", "EXTRACTED", None), ("a", "a", "imports", "EXTRACTED", None), ("a", "q", "calls", "EXTRACTED", None), ("b", "c", "imports", "EXTRACTED", None)], EDGE)
    assert sorted((r["src"], r["dst"], r["confidence"]) for r in graph.admit(nodes, edges).collect()) == [("a", "b", "EXTRACTED"), ("a", "c", "EXTRACTED")]


def test_bm25_by_hand(spark):
    d = spark.createDataFrame([("a", "token save token"), ("b", "user name"), ("c", "user token")], "doc_id string, text string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(d, ["token"]).collect()}
    assert set(got) == {"a", "c"} and got["a"] > got["c"]
    assert abs(got["a"] - 0.470004 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (7 / 3)))) < 1e-5


def test_deduplication(spark):
    data = [("n1", "User Service Catalogue", "a.md"), ("n2", "user-service catalogue", "b.md"), ("n3", "User Service Catalogues", "c.md"), ("n4", "Order Service", "a.md"), ("n5", "ADR 0011 on storage design", "a.md"), ("n6", "ADR 0013 on storage design", "a.md")]
    n = spark.createDataFrame([(i, x, "concept", f) for i, x, f in data], "id string, label string, file_type string, source_file string")
    out = {r["id"]: r["survivor"] for r in dedup.dedup_entities(n).collect()}
    assert out == {"n1": "n1", "n2": "n1", "n3": "n1"}
    e = spark.createDataFrame([("n1", "n2", "r"), ("n2", "n4", "r"), ("n3", "n4", "r")], "src string, dst string, relation string")
    assert list(map(tuple, dedup.rewire(e, dedup.dedup_entities(n)).collect())) == [("n1", "n4", "r")]


def test_claims(spark, diamond):
    nodes, edges = diamond
    c = spark.createDataFrame([(1, "calls", "A", "B", None), (2, "calls", "B", "A", None), (3, "exists", "run", None, None), (4, "exists", "zzz", None, None)], "claim_id int, type string, source string, target string, relation string")
    assert {r["claim_id"]: r["verdict"] for r in claims.check(c, nodes, edges).collect()} == {1: "SUPPORTED", 2: "UNKNOWN", 3: "SUPPORTED", 4: "UNKNOWN"}


def test_call_resolution_prefers_the_nearest(spark):
    calls = spark.createDataFrame([(1, "f", "a/b/x.py"), (2, "f", "q/x.go"), (3, "g", "a/b/x.py")], "call_id int, callee string, source_file string")
    defs = spark.createDataFrame([("d1", "f", "a/b/y.py"), ("d2", "f", "a/c/y.py"), ("d3", "g", "k/1.py"), ("d4", "g", "k/2.py")], "id string, label string, source_file string")
    assert list(map(tuple, resolution.resolve_calls(calls, defs).collect())) == [(1, "d1")]


def test_python_and_sql_sources(spark):
    code = "import os\nfrom a.b import c\nclass K(Base):\n    def m(self):\n        return os.path.join(c())\ndef f(): pass\n"
    facts = extract.python_facts(code)
    assert {("imports", "", "os"), ("imports_from", "", "a.b.c"), ("class", "K", ""), ("inherits", "K", "Base"), ("method", "m", "K"), ("calls", "K.m", "os.path.join"), ("function", "f", "")} <= set(facts)
    assert extract.python_facts("def (") == [("error", "", "")]
    d = spark.createDataFrame([("x.sql", "CREATE TABLE a (id int, b int REFERENCES t2(id)); create table if not exists t2 (id int);")], "path string, text string")
    assert sorted((r["kind"], r["name"], r["target"]) for r in extract.extract_sql(d).collect()) == [("references", "a", "t2"), ("table", "a", ""), ("table", "t2", "")]
    assert extract.extract_python(spark.createDataFrame([("a.py", code)], "path string, text string")).count() == len(facts)


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1) # two words")
    (tmp_path / "b.md").write_text("# hi")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["words"]) for r in extract.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {"x.py": ("code", 4), "b.md": ("document", 2)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_properties(a, b):
    assert T.jaro_one(a, b) == pytest.approx(T.jaro_one(b, a)) or abs(T.jaro_one(a, b) - T.jaro_one(b, a)) < 0.2
    assert 0 <= T.jaro_winkler_one(a, b) <= 1 and T.jaro_winkler_one(a, a) == 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab#\n", max_size=200), st.integers(5, 40))
def test_slices_are_gap_free(t, most):
    parts = extract.cut(t, most)
    assert "".join(t[a:b] for a, b in parts) == t and all(b - a <= most for a, b in parts)


def test_ids(spark):
    d = spark.createDataFrame([("Straße  X--y",), ("",), (None,), ("__a__b",)], "s string")
    once = [r[0] for r in d.select(T.normal_id("s")).collect()]
    assert once == ["strasse_x_y", "", "", "a_b"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in once], "s string").select(T.normal_id("s")).collect()] == once
    assert [r[0] for r in spark.createDataFrame([("Crème Brûlée",)], "s string").select(T.strip_marks("s")).collect()] == ["Creme Brulee"]


def test_distances_in_a_deep_graph(spark):
    chain = spark.createDataFrame([(f"v{k:03}", f"v{k + 1:03}", "calls", "EXTRACTED", "call") for k in range(54)], EDGE)
    assert {r["id"]: r["distance"] for r in traverse.distances(chain, "v000", weighted=False).collect()} == {f"v{k:03}": k for k in range(55)}


def test_each_term_has_a_seed(spark):
    labels = ["token", "load users page", "my users", "store", "storehouse rules", "shadow"]
    nodes = spark.createDataFrame([(f"n{k}", x, "code", "s.py", 0) for k, x in enumerate(labels)], NODE)
    edges = spark.createDataFrame([("n2", "n5", "calls", "EXTRACTED", "call"), ("n0", "n3", "calls", "EXTRACTED", "call")], EDGE)
    assert [r["id"] for r in retrieval.pick_seeds(retrieval.score_nodes(nodes, ["token", "users"])).collect()] == ["n0"]
    assert retrieval.all_seeds(nodes, edges, ["token", "users"]) == ["n0", "n2"]
    assert {r["term"]: r["id"] for r in retrieval.term_seeds(nodes, edges, ["token", "users", "nothing"]).collect()} == {"token": "n0", "users": "n2"}
    got = {r["id"] for r in retrieval.retrieve(nodes, edges, "token users", depth=1).collect()}
    assert {"n0", "n2", "n5"} <= got


def test_files_and_communities_decide_what_merges(spark):
    pair = "a string, b string, one_file boolean, one_community boolean, anchored boolean"
    x, y = "graph storage engine", "graph storage enigma"
    j, jw = 100 * T.jaro_one(x, y), 100 * T.jaro_winkler_one(x, y)
    assert 87 <= j < 92 <= jw
    data = [(x, y, False, False, False), (x, y, True, False, False), (x, y, False, True, False), (x, y, False, True, True)]
    got = [dedup.similar(spark.createDataFrame([d], pair)).count() for d in data]
    assert got == [0, 1, 1, 0]
    n = spark.createDataFrame([("d1", "Overview of the service", "document", "a.md"), ("d2", "Overview of the service", "document", "b.md"), ("d3", "overview of the service", "document", "a.md"), ("c1", "Storage of the service", "concept", "a.md"), ("c2", "storage of the service", "concept", "b.md")], "id string, label string, file_type string, source_file string")
    assert {r["id"]: r["survivor"] for r in dedup.dedup_entities(n).collect()} == {"d1": "d1", "d3": "d1", "c1": "c1", "c2": "c1"}


def test_parts_of_names_meet_few_nodes(spark):
    labels = [f"Customer#{k:09}" for k in range(400)]
    nodes = spark.createDataFrame([(f"c{k}", x, "a/b.py") for k, x in enumerate(labels)] + [("d1", "my.Customer#000000007()", "q.go"), ("d2", "xy", ""), ("d3", None, None)], "id string, label string, source_file string")
    asked = [*labels, "omer#00000000", "7", "xy", "b.py", "pkg.Customer#000000007", "D3", "no one"]
    q = spark.createDataFrame([(x,) for x in asked], "name string")
    got = {}
    for r in claims.candidates(q, nodes, most=1000).collect():
        got.setdefault(r["name"], set()).add((r["id"], r["tier"]))
    assert {(i, t) for i, t in got["Customer#000000007"]} == {("c7", 1), ("d1", 2)} and got["Customer#000000008"] == {("c8", 1)}
    assert got["omer#00000000"] == {(f"c{k}", 4) for k in range(10)} | {("d1", 4)}
    assert got["7"] == {(f"c{k}", 4) for k in range(400) if "7" in str(k)} | {("d1", 4)}
    assert got["xy"] == {("d2", 1)} and got["pkg.Customer#000000007"] == {("c7", 2), ("d1", 2)} and got["D3"] == {("d3", 0)} and "no one" not in got
    assert got["b.py"] == {(f"c{k}", 3) for k in range(400)} | set()
    pairs = claims._parts(spark.createDataFrame([(x, x.lower(), x.lower()) for x in labels], "name string, q string, bq string"), nodes.filter("label IS NOT NULL").select("id", F.lower("id").alias("nid"), F.lower("label").alias("label"), F.lower("label").alias("bare")))
    joins = [x for x in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "NestedLoop" in x or "Cartesian" in x]
    assert pairs.distinct().count() == 401 and not joins


def test_shuffles_grow_with_tables_and_statuses_are_hashed(spark, sf, monkeypatch):
    from loomgraph.sources import storage, testgraph

    had = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(storage, "BYTES_A_PARTITION", 10_000)
    try:
        lines = storage.table(spark, sf, "lineitem")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert parts > int(had) and storage.table(spark, sf, "region") is not None and int(spark.conf.get("spark.sql.shuffle.partitions")) == parts
        assert storage.spread(lines, "l_orderkey").rdd.getNumPartitions() == parts
        plan = testgraph.trade(spark, sf).edges._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    d = spark.createDataFrame([(x,) for x in ("", "A", "B", "F", "G", "N", "NN", "O", "P", None)], "s string")
    ranks = [r[0] for r in d.select(testgraph._rank("s")).collect()]
    assert ranks == [0, 1, 2, 3, 4, 5, 6, 7, 8, None]
    assert [r[0] for r in d.select(testgraph._confidence_of(testgraph._rank("s"))).collect()] == [r[0] for r in d.select(testgraph._confidence(F.col("s"))).collect()]


def test_pairs_are_made_where_they_are_counted(spark):
    from loomgraph.operators import answers, build

    t = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1), ("x", 2), ("y", 2), ("y", 2), ("z", None), ("x", None), (None, 1)], "change string, community int")
    out = answers.review_conflicts(t)
    assert sorted(map(tuple, out.collect())) == [("x", "y", 2), ("x", "z", 1), ("y", "z", 1)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    i = spark.createDataFrame([("f", "m", "n"), ("f", "m", "n"), ("g", "m", "n")], "source_file string, module string, name string")
    c = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f"), ("b", "f"), ("c", None)], "id string, source_file string")
    e = spark.createDataFrame([("t", "m", "n"), ("a", "m", "n"), ("t", "m", "n")], "id string, module string, name string")
    uses = build.import_uses(i, c, e)
    assert sorted(map(tuple, uses.collect())) == [("a", "t"), ("b", "a"), ("b", "t")]
    assert uses._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].startswith("Union")  # pairs aren't made distinct all together


def test_no_broadcast_in_rounds(spark, monkeypatch):
    from loomgraph.operators import community

    seen, real = [], community.materialise

    def watch(df, name="step"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(community, "materialise", watch)
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")], "src string, dst string")
    assert community.louvain(nodes, edges).select("community").distinct().count() == 2
    assert seen and not any("BroadcastHashJoin" in p for p in seen)


def test_edges_of_a_question_are_made_once(spark, monkeypatch):
    from loomgraph.operators import retrieval

    made, real = [], retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df, name="step": made.append(name) or real(df, name))
    nodes = spark.createDataFrame([("n0", "token", "code", "s.py", 0), ("n1", "other", "code", "s.py", 0)], NODE)
    edges = spark.createDataFrame([("n0", "n1", "calls", "EXTRACTED", "call")], EDGE)
    assert {r["id"] for r in retrieval.retrieve(nodes, edges, "token").collect()} == {"n0", "n1"} and made == ["edges"]


def test_evidence_of_short_and_long_items(spark):
    items = spark.createDataFrame([(1, "Red ring"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h x"), (4, ""), (5, None)], "item_id int, text string")
    texts = spark.createDataFrame([(1, "the red  ring, here"), (2, "z a b c d e f g h i j"), (3, None), (4, "redring red")], "doc_id int, text string")
    assert sorted(map(tuple, claims.evidence(items, texts).collect())) == [(1, 1), (2, 2)]


def test_best_edge_in_either_direction_scores_a_path(spark):
    from math import exp, log

    edges = spark.createDataFrame([("a", "b", "imports", "EXTRACTED", None), ("b", "a", "calls", "EXTRACTED", None), ("b", "c", "imports", "EXTRACTED", None), ("x", "y", "calls", "EXTRACTED", None)], EDGE)
    paths = spark.createDataFrame([("p", "a", "b"), ("p", "c", "b"), ("q", "c", "a")], "path string, src string, dst string")
    got = {r["path"]: r["score"] for r in traverse.path_score(edges, paths).collect()}
    assert got == {"p": pytest.approx(exp((log(1.0) + log(0.4)) / 2))}
