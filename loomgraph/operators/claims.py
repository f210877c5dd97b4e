"""Claims about a graph, with three-valued verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise, spread

# Which relations prove which kind of claim.
GROUPS = {"calls": ("calls", "indirect_call"), "imports": ("imports", "imports_from", "uses"), "inherits": ("inherits", "extends", "implements", "overrides", "mixes_in"), "method_of": ("method", "contains", "defines")}
SUPPORTED, CONTRADICTED, UNKNOWN = "SUPPORTED", "CONTRADICTED", "UNKNOWN"


def norm(text: Column) -> Column:
    """Lower case, slashes forward, :: as a dot, single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("\\"), F.lit("/")), F.lit("::"), F.lit(".")), r"\s+", " "))


def bare_name(label: Column) -> Column:
    """The last part of a label between dots and slashes, without a call's parentheses."""
    return F.element_at(F.split(F.element_at(F.split(F.regexp_replace(F.trim(label), r"\(\)$", ""), r"\."), -1), "/"), -1)


#: Lengths of the windows that parts of names are looked up by; two windows of the greatest that fits cover a name under the next.
WINDOWS = (1, 2, 3, 6, 12, 24, 48, 96)


def _windows(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of each of the given lengths in a text."""
    none = F.array().cast("array<string>")

    def runs(k: int) -> Column:
        return F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(none)

    return F.array_distinct(F.concat(*map(runs, sizes)))


def _ends(text: Column) -> Column:
    """The first and the last window of a name, of the greatest length in WINDOWS that fits; none of an empty one."""
    size = F.coalesce(*[F.when(F.length(text) >= k, F.lit(k)) for k in reversed(WINDOWS)])
    return F.when(size.isNotNull(), F.array_distinct(F.array(F.substring(text, F.lit(1), size), F.substring(text, F.length(text) - size + 1, size))))


def _parts(q: DataFrame, n: DataFrame) -> DataFrame:
    """(name, id) where the label or id holds q, or the last part of the label bq. Windows of nodes that a name begins or ends with
    are kept and counted; then a name is tried on the nodes that have the rarer one of its two, be they many for the other."""
    want = q.select("name", F.explode(F.array(F.struct(F.lit(False).alias("bare"), F.col("q").alias("text")), F.struct(F.lit(True).alias("bare"), F.col("bq").alias("text")))).alias("w")).select("name", "w.*")
    want = materialise(want.filter("text <> ''").select("name", "bare", "text", F.explode(_ends(F.col("text"))).alias("gram")), "wanted")
    sizes = sorted(r[0] for r in want.select(F.length("gram")).distinct().collect())  # of WINDOWS
    if not sizes:
        return q.select("name", F.lit("").alias("id")).limit(0)
    where = F.array_union(F.array_union(_windows(F.col("label"), sizes), _windows(F.col("nid"), sizes)), _windows(F.col("bare"), sizes))
    places = spread(n, "id").select("id", "label", "nid", F.col("bare").alias("own"), F.explode(where).alias("gram"))
    places = materialise(places.join(want.select("gram").distinct(), "gram", "left_semi"), "windows")
    rows = places.groupBy("gram").agg(F.count("*").alias("n"))
    rare = want.join(rows, "gram").groupBy("name", "bare", "text").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("there"), F.min("n").alias("n"))
    rare = rare.join(want.groupBy("name", "bare").agg(F.count("*").alias("of")), ["name", "bare"]).filter("there = of")  # else no node has both
    inside = F.when(F.col("bare"), F.contains("own", "text")).otherwise(F.contains("label", "text") | F.contains("nid", "text"))
    return places.join(materialise(rare.select("name", "bare", "text", "gram"), "rare"), "gram").filter(inside).select("name", "id")


def candidates(names: DataFrame, nodes: DataFrame, most: int = 8) -> DataFrame:
    """(name, id, tier, place): the nodes that a name may mean, `most` at most: by id (0), label (1), last part of the label (2),
    ending of the file's path (3), part of the label or id (4); ties by id.

    Names and nodes meet by keys: whole ones, up to twelve last characters of paths, and for parts the rarer of the windows that
    a name begins and ends with; the rest is verified. Names are written first, so that a few are sent to the nodes, and
    never the nodes to them.
    """
    n = nodes.select("id", norm(F.col("id")).alias("nid"), norm(F.coalesce("label", "id")).alias("label"), norm(bare_name(F.coalesce("label", "id"))).alias("bare"), norm(F.coalesce("source_file", F.lit(""))).alias("file"))
    q = names.select("name").distinct().select("name", norm(F.col("name")).alias("q"), norm(bare_name(F.col("name"))).alias("bq")).filter("q <> ''")
    q = materialise(q, "names")
    k = lambda tier, key: F.struct(F.lit(tier).alias("tier"), key.alias("key"))
    keys = n.select("id", F.explode(F.array(k(0, F.col("nid")), k(0, F.lower("id")), k(1, F.col("label")), k(1, F.regexp_replace("label", r"[()]+$", "")))).alias("k")).select("id", "k.*").distinct()
    exact = q.join(keys, F.col("q") == F.col("key")).select("name", "id", "tier")
    by_bare = q.filter("bq <> ''").join(n.select("id", "bare"), F.col("bq") == F.col("bare")).select("name", "id", F.lit(2).alias("tier"))
    part = _parts(q, n).select("name", "id", F.lit(4).alias("tier"))
    tail = q.select("name", "q", F.substring("q", -12, 12).alias("t"))
    files = n.filter("file <> ''").select("file").distinct()
    files = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("file"), F.lit(12))), lambda i: F.substring(F.col("file"), -i, i))).alias("t"))
    ended = tail.join(files, "t").filter(F.endswith("file", F.col("q"))).select("name", "file").distinct()
    cut = ended.join(n.select("id", "file"), "file").select("name", "id", F.lit(3).alias("tier"))
    hit = exact.union(by_bare).union(part).union(cut).groupBy("name", "id").agg(F.min("tier").alias("tier"))
    salt = F.pmod(F.xxhash64("id"), F.lit(32))  # a common name's nodes are ranked in parts first
    first = hit.withColumn("p", F.row_number().over(Window.partitionBy("name", salt).orderBy("tier", "id"))).filter(F.col("p") <= most)
    best = first.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("tier", "id")))
    return best.filter(F.col("place") <= most).select("name", "id", "tier", "place")


def resolve(names: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """(name, id): the first `most` of the candidates of each name."""
    return candidates(names, nodes).filter(F.col("place") <= most).select("name", "id")


def check(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, verdict) for claims (claim_id, type, source, target, relation). An `exists` claim is supported if its source
    resolves; a relation one if some candidates are joined by a proving relation, in its direction. `inherits` and
    `method_of` are contradicted if both ends resolve and the first has such relations, only to others."""
    names = claims.select(F.col("source").alias("name")).union(claims.select("target")).dropna()
    found = materialise(resolve(names, nodes), "found")
    ids = found.select("id").distinct()
    # only edges between nodes that a claim may mean decide whether one holds
    near = edges.select("src", "dst", "relation").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    near = materialise(near.distinct(), "near")
    ends = claims.join(found.select(F.col("name").alias("source"), F.col("id").alias("s")), "source", "left").join(found.select(F.col("name").alias("target"), F.col("id").alias("t")), "target", "left")
    proof = [(k, r) for k, rs in GROUPS.items() for r in rs]
    spark = claims.sparkSession
    proves = F.broadcast(spark.createDataFrame(proof, "type string, relation string"))  # a fixed list
    typed = near.join(proves, "relation").select("type", F.when(F.col("type") == "method_of", F.col("dst")).otherwise(F.col("src")).alias("s"), F.when(F.col("type") == "method_of", F.col("src")).otherwise(F.col("dst")).alias("t"))
    own = near.select(F.lit("relation").alias("type"), "src", "dst", "relation")
    hit = ends.join(typed.distinct().withColumn("hit", F.lit(True)), ["type", "s", "t"], "left")
    hit = hit.join(own.select("type", F.col("src").alias("s"), F.col("dst").alias("t"), "relation").distinct().withColumn("named", F.lit(True)), ["type", "s", "t", "relation"], "left")
    # what the owner of a claim has of that kind at all: for inherits its own edges, for method_of those of the target, which
    # stand at the same end; of other kinds nothing is contradicted
    owns = edges.filter(F.col("relation").isin(*[r for k, r in proof if k in ("inherits", "method_of")])).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    has = owns.join(proves, "relation").select("type", F.col("src").alias("owner")).distinct().withColumn("has", F.lit(True))
    hit = hit.withColumn("owner", F.when(F.col("type") == "method_of", F.col("t")).otherwise(F.col("s"))).join(has, ["type", "owner"], "left")
    by = hit.groupBy("claim_id", "type").agg(
        F.max(F.coalesce("hit", "named", F.lit(False))).alias("hit"), F.max(F.col("s").isNotNull()).alias("s"), F.max(F.col("t").isNotNull()).alias("t"), F.max(F.coalesce("has", F.lit(False))).alias("has")
    )
    verdict = F.when(F.col("type") == "exists", F.when(F.col("s"), SUPPORTED).otherwise(UNKNOWN)).when(F.col("hit"), SUPPORTED).when(F.col("type").isin("inherits", "method_of") & F.col("s") & F.col("t") & F.col("has"), CONTRADICTED).otherwise(UNKNOWN)
    return by.select("claim_id", "type", verdict.alias("verdict"))


def roll_up(verdicts: DataFrame, group: str) -> DataFrame:
    """(group, verdict): contradicted if any is, supported if all are, else unknown."""
    worst = F.when(F.max((F.col("verdict") == CONTRADICTED).cast("int")) == 1, CONTRADICTED).when(F.min((F.col("verdict") == SUPPORTED).cast("int")) == 1, SUPPORTED).otherwise(UNKNOWN)
    return verdicts.groupBy(group).agg(worst.alias("verdict"))


def evidence(items: DataFrame, texts: DataFrame, grams: int = 8) -> DataFrame:
    """(item_id, doc_id) of items (item_id, text) whose words stand in a document in order: an equi-join on the hash of an
    item's first words, or all if it has fewer than `grams`, finds the candidates by number; only then texts are looked at."""
    from ..functions.text import tokens

    i = items.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("w")).filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(grams)))
    i = i.select("item_id", F.array_join("w", " ").alias("phrase"), "n", "w")
    sizes = sorted(r[0] for r in i.select("n").distinct().collect())  # grams numbers at most
    key = lambda words, start, n: F.xxhash64(F.lit(n), *[F.get(words, start + k) for k in range(n)])  # noqa: E731  no text is put together
    first = F.coalesce(*[F.when(F.col("n") == n, key(F.col("w"), F.lit(0), n)) for n in sizes]) if sizes else F.lit(0)
    i = i.select("item_id", "phrase", first.alias("key"))
    d = texts.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w"))

    def windows_of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("w") - n)
        return F.when(F.size("w") >= n, F.transform(starts, lambda s: key(F.col("w"), s, n))).otherwise(F.array().cast("array<bigint>"))

    windows = [windows_of(n) for n in sizes]
    if not windows:
        return i.select("item_id").crossJoin(d.select("doc_id")).limit(0)
    found = d.select("doc_id", F.explode(F.array_distinct(F.concat(*windows))).alias("key")).join(i.select("item_id", "key"), "key").select("item_id", "doc_id").distinct()
    # only texts with a candidate are taken apart again
    both = found.join(i.select("item_id", "phrase"), "item_id").join(texts.select("doc_id", "text"), "doc_id")
    both = both.withColumn("body", F.concat(F.lit(" "), F.array_join(tokens(F.coalesce("text", F.lit(""))), " "), F.lit(" ")))
    return both.filter(F.contains("body", F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("item_id", "doc_id").distinct()
