"""The pipeline's stages against brute force on the smallest tables."""

import itertools
import re

import corpus_pipeline
from loomgraph.llm import quality


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        at = f"file://{tmp_path}/{re.sub(r'[^a-z0-9]', '-', name)}"
        stage(spark, seen[-1], sf).write.mode("overwrite").parquet(at)
        seen.append(spark.read.parquet(at))
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:-1]]
    assert all(d.columns == columns for d in seen[:-1])
    scores = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(texts[1]) == {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    sets = {}
    for k, t in texts[1].items():
        w = t.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if texts[1][a] == texts[1][b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    up = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    assert set(texts[2]) == {k for k, v in up.items() if k == v}
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {k for k, t in texts[2].items() if any(f" {' '.join(i)} " in f" {' '.join(re.findall(r'\w+', t.lower()))} " for i in items)}
    assert not whole & set(texts[3])
    assert set(texts[2]) - set(texts[3]) == whole
    assert set(texts[4]) <= set(texts[3]) and len(texts[4]) > len(texts[3]) / 4
    last = seen[-1].collect()
    assert sorted(r["doc_id"] for r in last) == sorted(texts[4])
    at = 0
    for r in sorted(last, key=lambda r: r["doc_id"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_a_tiny_cell_does_not_empty_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tiny = spark.createDataFrame([(10**9, "word " * 20, "xx", "nowhere", 100)], docs.schema)
    words = lambda df: {r["doc_id"]: len(r["text"].split()) for r in df.collect()}
    total = sum(words(docs).values())
    before = words(corpus_pipeline.mixing_sources(spark, docs, sf))
    after = words(corpus_pipeline.mixing_sources(spark, docs.union(tiny), sf))
    assert 10**9 in after and sum(before.values()) > 0.8 * total
    assert abs(sum(after.values()) - sum(before.values())) < 0.02 * total
