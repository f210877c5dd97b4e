"""Retrieval: term weights, node scores, seeds, BM25, rank fusion, budgets, metrics, trigram candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingles, tokens
from ..sources.storage import materialise

BM25_K, BM25_B, RRF_K = 1.2, 0.75, 60


def term_weights(labels: DataFrame, terms: list[str], column: str = "label") -> DataFrame:
    """(term, df, idf): in how many labels a term occurs, and ln(1 + N / (1 + df)), in one pass over all terms."""
    low = F.lower(F.col(column))
    row = labels.agg(F.count("*").alias("n"), *[F.sum(F.contains(low, F.lit(t)).cast("long")).alias(f"t{k}") for k, t in enumerate(terms)])
    out = row.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"t{k}"), F.lit(0)).alias("df")) for k, t in enumerate(terms)])).alias("x"))
    return out.select("x.term", "x.df", F.log(1 + F.col("n") / (1 + F.col("x.df"))).alias("idf"))


def _tier(label: Column, bare: Column, tokens_: Column, node: Column, term: str) -> tuple[Column, Column, Column]:
    t = F.lit(term)
    return (label == t) | (bare == t), F.startswith(label, t) | F.startswith(bare, t), F.contains(label, t)


def score_nodes(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, label, score) of nodes (id, label, source_file) that match: for each term, by its weight, 1000 for an equal
    label, else 100 for a prefix, 1 for a part, and 0.5 in the file name; the first two scaled by the square of the part of
    terms that match; the whole question adds 10000 if equal, else 1000 if a prefix. One projection, no join."""
    idf = {r["term"]: r["idf"] for r in term_weights(nodes, terms).collect()}
    label = F.lower(F.coalesce("label", F.lit("")))
    bare = F.regexp_replace(label, r"[()]+$", "")
    file = F.lower(F.coalesce("source_file", F.lit("")))
    tiers, direct, matched = F.lit(0.0), F.lit(0.0), F.lit(0)
    for t in terms:
        equal, prefix, part = _tier(label, bare, None, F.col("id"), t)
        w = F.lit(float(idf[t]))
        tiers = tiers + F.when(equal, 1000 * w).when(prefix, 100 * w).otherwise(0.0)
        direct = direct + F.when(~equal & ~prefix & part, w).otherwise(0.0) + F.when(F.contains(file, F.lit(t)), 0.5 * w).otherwise(0.0)
        matched = matched + (equal | prefix | part).cast("int")
    q, most = " ".join(terms), float(max(idf.values(), default=0.0))
    equal = (label == q) | (bare == q) | (F.array_join(tokens(label), " ") == q) | (F.col("id") == q)
    prefix = F.startswith(label, F.lit(q)) | F.startswith(bare, F.lit(q))
    whole = F.when(equal, 10000 * most).when(prefix, 1000 * most).otherwise(0.0)
    score = whole + tiers * F.pow(matched / F.lit(float(max(1, len(terms)))), F.lit(2.0)) + direct
    return nodes.select("id", "label", score.alias("score")).filter("score > 0")


def pick_seeds(scored: DataFrame, most: int = 3, gap: float = 0.2) -> DataFrame:
    """Up to `most` best nodes with different labels, none under `gap` of the best; ties by label length and id."""
    order = [F.desc("score"), F.length("label"), "id"]
    one = scored.groupBy("label").agg(F.min_by(F.struct("id", "score"), F.struct((-F.col("score")).alias("s"), F.length("label").alias("n"), "id")).alias("b")).select("b.id", "label", "b.score")
    best = one.agg(F.max("score").alias("best"))
    return one.crossJoin(F.broadcast(best)).filter(F.col("score") >= gap * F.col("best")).select("id", "label", "score").orderBy(*order).limit(most)


def term_seeds(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """(term, id, label): the best node of each term by itself: 10000 for an equal label or id, else 1000 for a prefix, and what
    `score_nodes` gives the term; ties by degree, label length and id. One pass over the nodes for all terms."""
    from .graph import degrees

    idf = {r["term"]: r["idf"] for r in term_weights(nodes, terms).collect()}
    label = F.lower(F.coalesce("label", F.lit("")))
    bare = F.regexp_replace(label, r"[()]+$", "")
    words = F.array_join(tokens(label), " ")
    file = F.lower(F.coalesce("source_file", F.lit("")))
    each = []
    for t in terms:
        equal, prefix, part = _tier(label, bare, None, F.col("id"), t)
        w = F.lit(float(idf[t]))
        alone = F.when(equal | (words == t) | (F.lower("id") == t), 10000 * w).when(prefix | F.startswith(words, F.lit(t)), 1000 * w).otherwise(0.0)
        tier = F.when(equal, 1000 * w).when(prefix, 100 * w).when(part, w).otherwise(0.0)
        each.append(F.struct(F.lit(t).alias("term"), (alone + tier + F.when(F.contains(file, F.lit(t)), 0.5 * w).otherwise(0.0)).alias("score")))
    if not each:
        return nodes.select(F.lit("").alias("term"), "id", "label").limit(0)
    n = nodes.select("id", "label", F.explode(F.filter(F.array(*each), lambda x: x["score"] > 0)).alias("x")).join(degrees(edges), "id", "left")
    order = F.struct((-F.col("x.score")).alias("s"), (-F.coalesce("degree", F.lit(0))).alias("d"), F.length(F.coalesce("label", "id")).alias("n"), "id")
    return n.groupBy("x.term").agg(F.min_by(F.struct("id", "label"), order).alias("b")).select("term", "b.id", "b.label")


def all_seeds(nodes: DataFrame, edges: DataFrame, terms: list[str], most: int = 3, gap: float = 0.2) -> list[str]:
    """Ids of `pick_seeds`, then of each term's best node, in the order of terms, if neither it nor its label is there yet, so
    that one term's match cannot keep out the others'. At most `most` and one for each term."""
    terms = list(dict.fromkeys(terms))
    key = lambda r: (r["label"] or "").lower() or r["id"]
    ranked = pick_seeds(score_nodes(nodes, terms), most, gap).collect()
    seeds, taken = [r["id"] for r in ranked], {key(r) for r in ranked}
    for r in term_seeds(nodes, edges, terms).orderBy("term").collect() if seeds else []:
        if r["id"] not in seeds and key(r) not in taken:
            seeds.append(r["id"])
            taken.add(key(r))
    return seeds


def find_node(nodes: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(id, label, tier): source path equal, label equal, label prefix, label part; best tier first."""
    q = query.lower()
    low = F.lower("label")
    tier = F.when(F.lower("source_file") == q, 0).when((low == q) | (F.lower("id") == q), 1).when(F.startswith(low, F.lit(q)), 2).when(F.contains(low, F.lit(q)), 3)
    return nodes.select("id", "label", tier.alias("tier")).filter("tier IS NOT NULL").orderBy("tier", F.length("label"), "id").limit(most)


def trigram_index(nodes: DataFrame) -> DataFrame:
    """(gram, id) postings of labels; written once, it answers `trigram_search` without a scan of labels."""
    return nodes.select(F.explode(shingles(F.lower("label"), 3)).alias("gram"), "id")


def trigram_search(nodes: DataFrame, index: DataFrame, needle: str) -> DataFrame:
    """(id, label) of labels that hold the needle: those with all its trigrams, verified; under three characters all are tried."""
    low = needle.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if grams:
        ids = index.filter(F.col("gram").isin(*grams)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
        nodes = nodes.join(ids.select("id"), "id", "left_semi")
    return nodes.filter(F.contains(F.lower("label"), F.lit(low))).select("id", "label")


def bm25(docs: DataFrame, query: list[str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of documents with a query term. Frequencies of the few query terms are counted where a document is read,
    so only one row of totals is shuffled."""
    terms = sorted(set(query))

    def times(term: str) -> Column:
        return F.size(F.filter("__tokens", lambda x: x == F.lit(term)))

    d = docs.select(F.col(id_column).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("__tokens"))
    d = d.select("id", F.size("__tokens").alias("len"), *[times(t).alias(f"f{k}") for k, t in enumerate(terms)])
    total = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"d{k}") for k in range(len(terms))]).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        df = total[f"d{k}"] or 0
        idf = F.log(F.lit(1 + (total["n"] - df + 0.5) / (df + 0.5)))
        f = F.col(f"f{k}").cast("double")
        score = score + idf * f * (BM25_K + 1) / (f + BM25_K * (1 - BM25_B + BM25_B * F.col("len") / F.lit(float(total["avg"] or 1.0))))
    return d.filter(" OR ".join(f"f{k} > 0" for k in range(len(terms))) or "false").select("id", score.alias("score"))


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of (id, rank) lists, ranks from 1."""
    out = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        out = out.union(r.select("id", "rank"))
    return out.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def top_ranked(scored: DataFrame, n: int) -> DataFrame:
    """(id, rank) of the n best; the window runs over what the limit left."""
    top = scored.orderBy(F.desc("score"), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rank")


def within_budget(lines: DataFrame, budget: int, group: str) -> DataFrame:
    """Lines (group, place, line) of each group, in order of place, as long as their lengths and line ends stay in budget."""
    w = Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(w)).filter(F.col("used") <= budget)


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, precision, recall, reciprocal_rank) of rankings (query, id, rank) against (query, id)."""
    r = relevant.select("query", "id").distinct()
    hits = ranked.join(r.withColumn("hit", F.lit(1)), ["query", "id"], "left")
    got = hits.groupBy("query").agg(
        F.sum(F.when((F.col("rank") <= k) & F.col("hit").isNotNull(), 1).otherwise(0)).alias("hits"), F.sum((F.col("rank") <= k).cast("int")).alias("shown"), F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first")
    )
    size = r.groupBy("query").agg(F.count("*").alias("relevant"))
    return got.join(size, "query").select("query", (F.col("hits") / F.col("shown")).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def query_terms(question: str, stop: frozenset[str] = frozenset("how what why when where which who does did is are was were be been can could should would will the and but not for from with this that it its of in on to".split())) -> list[str]:
    """Terms of one question: words of over two letters without stop words, or all of them if none is left."""
    import re

    words = [w for w in re.findall(r"\w+", question.lower()) if len(w) > 2 or not w.isascii()]
    return [w for w in words if w not in stop] or words


def retrieve(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, budget: int = 2000, contexts: list[str] | None = None, weighted: bool = True) -> DataFrame:
    """(place, id, line): what a question is answered from. Terms -> scores -> seeds -> neighbourhood -> ranking -> budget."""
    from .graph import degrees, in_context
    from .traverse import expand

    # what follows looks at edges four times: they are made once
    edges = materialise(edges.select("src", "dst", "relation", "confidence", "context"), "edges")
    seeds = all_seeds(nodes, edges, query_terms(question))
    spark = nodes.sparkSession
    if not seeds:
        return spark.createDataFrame([], "place bigint, id string, line string")
    near = expand(nodes, in_context(edges, contexts or []), seeds, depth, weighted, written=True)
    place = F.array_position(F.array(*map(F.lit, seeds)), F.col("id"))
    ranked = near.join(nodes.select("id", "label", "source_file"), "id").join(degrees(edges), "id", "left")
    order = [F.when(place > 0, place).otherwise(len(seeds) + 1), "distance", F.desc("importance"), F.desc(F.coalesce("degree", F.lit(0))), "id"]
    line = F.concat_ws(" ", "label", F.concat(F.lit("["), "source_file", F.lit("]")))
    top = ranked.orderBy(*order).limit(budget)  # a line is a character at least
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(0).alias("g"), "place", "id", line.alias("line"))
    return within_budget(top, 3 * budget, "g").select(F.col("place").cast("long").alias("place"), "id", "line")
