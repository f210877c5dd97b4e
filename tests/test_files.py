"""Graph files, scans on disk, streams in several batches, and operators without SQL against plain versions."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import answers, dedup, graph, traverse
from loomgraph.sources import graphs, languages, scan, sinks
from loomgraph.streaming import streams


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("a", "A", "code", "x.py"), ("b", "B", "code", "x.py"), ("c", 'C "<&>"', "concept", "")], "id string, label string, file_type string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls", "EXTRACTED"), ("b", "c", "uses", "INFERRED")], "src string, dst string, relation string, confidence string")
    return nodes, edges


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_document_comes_back(spark, small, tmp_path):
    nodes, edges = small
    at = f"file://{tmp_path}/graph"
    graphs.write_whole(graphs.document(nodes, edges), at)
    n, e = graphs.read_graph(spark, at)
    assert rows(n.select(*nodes.columns)) == rows(nodes) and rows(e.select(*edges.columns)) == rows(edges)
    graphs.write_whole(graphs.document(nodes.limit(1), edges.limit(0)), at, backup="2024-01-01")
    assert graphs.read_graph(spark, at)[0].count() == 1 and graphs.read_graph(spark, f"{at}.2024-01-01")[0].count() == 3
    several = edges.union(spark.createDataFrame([("a", "b", "imports", "EXTRACTED")], edges.schema))
    doc = json.loads(graphs.document(nodes, several).first()[0])
    assert doc["multigraph"] and doc["format"] == 2 and len(doc["links"]) == 3


def test_lines_come_back_and_are_replaced(spark, small, tmp_path):
    nodes, edges = small
    at = f"file://{tmp_path}/lines"
    schemas = ("id string, label string, file_type string, source_file string", "src string, dst string, relation string, confidence string, confidence_score double")
    sinks.write_graph(nodes, edges, at)
    n, e = graphs.read_lines(spark, at, *schemas)
    assert rows(n) == rows(nodes) and rows(e.select(*edges.columns)) == rows(edges)
    sinks.write_graph(n.withColumn("label", F.lower("label")), edges, at, previous=n, rebuilt=n.select("source_file"))  # read from where it is written
    assert {r["label"] for r in graphs.read_lines(spark, at, *schemas)[0].collect()} == {"a", "b", 'c "<&>"'}
    n = graphs.read_lines(spark, at, *schemas)[0]
    with pytest.raises(ValueError):
        sinks.write_graph(n.filter("id <> 'a'"), edges, at, previous=n)


def test_other_names_of_fields(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "name": "A", "kind": "code", "path": "x.py"}, {"key": "b", "title": "B"}, {"label": "none"}], "edges": [{"from": "a", "to": "b", "type": "calls"}, {"from": "a"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    n, e = graphs.read_graph(spark, f"file://{tmp_path}/g.json", tolerant=True)
    assert rows(n) == [("a", "A", "code", "x.py"), ("b", "B", None, None)] and rows(e) == [("a", "b", "calls", None)]
    doc = {"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "a", "relation": "calls", "confidence": "EXTRACTED", "secondary_relations": [{"relation": "manages", "confidence": "INFERRED"}]}]}
    (tmp_path / "h.json").write_text(json.dumps(doc))
    assert rows(graphs.read_graph(spark, f"file://{tmp_path}/h.json", expand=True)[1]) == [("a", "a", "calls", "EXTRACTED"), ("a", "a", "manages", "INFERRED")]


def test_feedback_lines_and_the_log(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"useful": true, "relations": ["calls"]}\nnot json\n{"useful": false, "relations": []}\n')
    assert graphs.read_feedback(spark, f"file://{tmp_path}/f.jsonl").count() == 2
    for k in range(2):
        graphs.log_query(spark, f"file://{tmp_path}/log", "query", "who?", "g", k)
    assert sorted(r["nodes_returned"] for r in spark.read.json(f"file://{tmp_path}/log").collect()) == [0, 1]


def test_scan_of_a_folder(spark, tmp_path):
    files = {"a.py": "x = 1", "run": "#!/usr/bin/env python\npass", "docs/b.md": "# T", "docs/.gitignore": "*.tmp\n", "docs/c.tmp": "x", "node_modules/d.js": "x", ".gitignore": "# all\n*.log\n!keep.log\nout2/\n", "e.log": "x", "keep.log": "x", "out2/keep.log": "x", "token.json": "x"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = scan.read_folder(spark, f"file://{tmp_path}")
    assert {r["path"] for r in found.collect()} == {f for f in files if not f.endswith(".gitignore")}
    rules = scan.ignore_rules(spark, f"file://{tmp_path}")
    assert {r["path"] for r in found.filter(scan.is_ignored(F.col("path"), rules)).collect()} == {"e.log", "out2/keep.log", "docs/c.tmp"}
    assert {r["path"]: r["kind"] for r in scan.counted(found, rules).collect()} == {"a.py": "code", "run": "code", "docs/b.md": "document"}
    scan.save_manifest(found, f"file://{tmp_path}/m1")
    old = scan.load_manifest(spark, f"file://{tmp_path}/m1")
    scan.save_manifest(found.filter("path = 'a.py'").withColumn("text", F.lit("new")), f"file://{tmp_path}/m2", old)
    new = {r["path"]: r["hash"] for r in scan.load_manifest(spark, f"file://{tmp_path}/m2").collect()}
    before = {r["path"]: r["hash"] for r in old.collect()}
    assert set(new) == set(before) and {p for p in new if new[p] != before[p]} == {"a.py"}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    schema = "id int, source_file string, v string"
    batches = [[(k, f"f{k % 40}", "0") for k in range(200)], [(500, "f1", "1")], [(600, "f1", "2"), (601, "new", "2")], []]
    want = {}
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        streams.upsert_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
        want = {x: y for x, y in want.items() if x[1] not in {r[1] for r in b}} | {r: None for r in b}
        assert {tuple(r) for r in streams.current(spark, f"file://{tmp_path}/t").collect()} == set(want), k
    kept = [p for p in (tmp_path / "t").glob("v=*/*") if p.is_dir()]
    assert len([p for p in kept if p.parent.name == "v=00000001"]) <= 1 and len(kept) < 64


def test_betweenness_against_all_paths(spark):
    r = random.Random(3)
    ids = [f"n{k}" for k in range(9)]
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if r.random() < 0.3]
    near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in ids}
    want = dict.fromkeys(ids, 0.0)
    for s, t in itertools.combinations(ids, 2):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            paths = [[*p, x] for p in paths for x in near[p[-1]] if x not in p]
        paths = [p for p in paths if p[-1] == t]
        for p in paths:
            for x in p[1:-1]:
                want[x] += 1 / len(paths)
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {x["id"]: x["score"] for x in answers.betweenness(nodes, spark.createDataFrame([*links, ("n0", "n0")], "src string, dst string")).collect()}
    assert got == pytest.approx(want)


def test_counts_of_neighbours_are_near(spark):
    e = spark.range(20_000).select((F.col("id") % 700).alias("src"), (F.col("id") % 9000).alias("dst"), F.lit("calls").alias("relation"))
    r = answers.distinct_neighbours(e).first()
    assert abs(r["sources"] - 700) < 50 and abs(r["targets"] - 9000) < 600


def test_pagerank_that_does_not_settle_is_an_error(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "calls", "EXTRACTED"), ("b", "a", "calls", "EXTRACTED")], "src string, dst string, relation string, confidence string")
    with pytest.raises(ValueError):
        traverse.pagerank(nodes, edges, ["a"], alpha=0.9999, tolerance=1e-12, most=3)
    assert traverse.affected(nodes, edges, "a", depth=0).count() == 0


def test_similar_sets_lose_no_pair(spark):
    r = random.Random(5)
    sets = {f"s{k}": sorted(r.sample("abcdefghij", r.randint(1, 8))) for k in range(60)}
    df = spark.createDataFrame(list(sets.items()), "label string, g array<string>")
    for least in (0.3, 0.6, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= least - 1e-9}
        assert {(x["a"], x["b"]) for x in dedup.similar_sets(df, least).collect()} == want


def test_several_repositories_are_not_merged(spark):
    nodes = spark.createDataFrame([("a", "A", "concept", "", "r1"), ("b", "A", "concept", "", "r2")], "id string, label string, file_type string, source_file string, repo string")
    with pytest.raises(ValueError):
        dedup.dedup_entities(nodes)


def test_comments_and_strings_declare_nothing():
    text = 'class A {\n  // class B { void no() {} }\n  /* class C {\n  } */\n  String s = "class D { void f() { g(); } }";\n  void m() { call("x(", /* y( */ 1); }\n}\n'
    assert [f[1:] for f in languages.facts(text, "java")] == [("class", "A", ""), ("calls", "m", "call"), ("method", "m", "A")]
    for name in languages.LANGUAGES:
        for odd in ("", "\n", '"', "/*", "'", "class", "x" * 5000, "(" * 2000, "{" * 2000, "/* " * 2000):
            languages.facts(odd, name)


def test_families_of_files(spark):
    df = spark.createDataFrame([("a.C",), ("b.hpp",), ("c.rake",), ("d.unknown",), (None,)], "p string")
    assert [r[0] for r in df.select(graph.family(F.col("p"))).collect()] == ["c", "c", "rb", None, None]
