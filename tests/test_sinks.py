import json

import pytest

from loomgraph.sources import sinks


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "it's", "x.py"), ("b", "B", "y.py")], "id string, label string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls-x", "INFERRED")], "src string, dst string, relation string, confidence string")
    got = {r["kind"]: json.loads(r["json"]) for r in sinks.node_link(nodes.limit(1), edges).collect()}
    assert got["link"]["confidence_score"] == 0.5 and got["node"]["label"] == "it's"
    lines = [r["statement"] for r in sinks.cypher(nodes, edges).collect()]
    assert "MERGE (n:Node {id: 'a'}) SET n.label = 'it\\'s';" in lines and "MATCH (a {id: 'a'}), (b {id: 'b'}) MERGE (a)-[:CALLS_X]->(b);" in lines
    at = f"file://{tmp_path}/g"
    sinks.write_graph(nodes, edges, at)
    assert spark.read.text(at).count() == 3
    with pytest.raises(ValueError):
        sinks.write_graph(nodes.limit(1), edges, at, previous=nodes)
    sinks.write_graph(nodes.limit(1), edges, at, previous=nodes, rebuilt=nodes)
