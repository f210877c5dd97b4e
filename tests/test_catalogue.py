"""Every query with SQL against DuckDB on the smallest tables, and the others by their properties."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_slices_join_to_the_text(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    parts = {}
    for r in catalogue.queries()["text_slices"](spark, sf).collect():
        parts.setdefault(r["doc_id"], []).append((r["part"], r["start"], r["end"]))
    for k, t in texts.items():
        p = sorted(parts[k])
        assert "".join(t[a:b] for _, a, b in p) == t and all(b - a <= 2000 for _, a, b in p)


def test_remap_is_one_to_one(spark, sf):
    out = catalogue.queries()["community_remap"](spark, sf).collect()
    assert out and len({r["old"] for r in out}) == len(out) == len({r["new"] for r in out})


def test_streams_agree_with_batches(spark, sf, tmp_path):
    from loomgraph.sources import testgraph
    from loomgraph.streaming import streams

    log = testgraph.feedback(spark, sf)
    log.repartition(3).write.json(f"{tmp_path}/log")
    stream = streams.feedback_counts(spark.readStream.schema(log.schema).json(f"{tmp_path}/log"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("relation", "exposures", "positives").collect()))
    assert key(spark.table("counts")) == key(streams.feedback_counts(log))
    schema = "id int, label string, source_file string"
    for k, data in enumerate(([(1, "a", "x"), (2, "b", "y")], [(3, "c", "x")])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        streams.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/changes"), f"file://{tmp_path}/t", f"{tmp_path}/check").awaitTermination()
        assert k == 1 or streams.current(spark, f"file://{tmp_path}/t").count() == 2
    assert sorted(map(tuple, streams.current(spark, f"file://{tmp_path}/t").collect())) == [(2, "b", "y"), (3, "c", "x")]
    assert os.path.isdir(f"{tmp_path}/t")


def test_import_cycles(spark, sf, con):
    pairs = con.sql("SELECT DISTINCT s_nationkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey").fetchall()
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    want = []

    def walk(path):
        for b in after.get(path[-1], []):
            if b == path[0]:
                want.append((len(path), ">".join(map(str, path))))
            elif b > path[0] and b not in path and len(path) < 5:
                walk([*path, b])

    for a in after:
        walk([a])
    assert max(want)[0] == 5
    assert sorted(map(tuple, catalogue.queries()["import_cycles"](spark, sf).select("length", "cycle").collect())) == sorted(want)


def test_pagerank_converges(spark, sf):
    from loomgraph.operators.graph import best_edges
    from loomgraph.sources import testgraph

    g = testgraph.trade(spark, sf)
    ids = [r["id"] for r in g.nodes.select("id").collect()]
    out = {}
    for r in best_edges(g.edges).collect():
        out.setdefault(r["src"], {})[r["dst"]] = r["importance"]
    rank, rounds = {x: 1 / len(ids) for x in ids}, 0
    while True:
        new = dict.fromkeys(ids, 0.0)
        for home in ("customer_7", "part_3"):
            new[home] = (0.15 + 0.85 * sum(v for x, v in rank.items() if x not in out)) / 2
        for x, to in out.items():
            for y, w in to.items():
                new[y] += 0.85 * rank[x] * w / sum(to.values())
        change, rank, rounds = sum(abs(new[x] - rank[x]) for x in ids), new, rounds + 1
        if change < 1e-6 * len(ids):
            break
    got = {r["id"]: r["score"] for r in catalogue.queries()["personalized_pagerank"](spark, sf).collect()}
    assert rounds > 5 and got.keys() == rank.keys()
    assert all(abs(got[x] - rank[x]) < 2e-7 for x in ids)


def test_communities_of_chains_are_whole(spark, sf, con):
    chains = con.sql("SELECT conv_id, min(turn), count(*), max(turn) - min(turn) + 1 FROM conversations GROUP BY conv_id").fetchall()
    assert all(n == span for _, _, n, span in chains) and max(n for _, _, n, _ in chains) > 6
    for name in ("label_propagation", "louvain_communities"):
        got = {}
        for r in catalogue.queries()[name](spark, sf).collect():
            got.setdefault(r["community"], set()).add(r["id"])
        assert {k: len(v) for k, v in got.items()} == {f"t{c:08d}_{first:06d}": n for c, first, n, _ in chains}


def test_god_nodes_leave_out_concepts_of_many_edges(spark, sf, con, tmp_path):
    """With many customers to a nation, nations are the best-connected nodes of all."""
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    con.sql(f"COPY (SELECT c_custkey + k * 1000000 AS c_custkey, * EXCLUDE c_custkey FROM '{sf}/customer.parquet', range(200) r(k)) TO '{tmp_path}/customer.parquet'")
    here = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        here.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalogue.queries()["god_nodes"](spark, str(tmp_path))
    want = here.sql(catalogue.oracle_sql()["god_nodes"])
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)
