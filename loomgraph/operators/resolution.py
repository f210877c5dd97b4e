"""Name resolution: calls to definitions, stubs to definitions, colliding ids, semantic to parsed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise, spread
from .graph import family


def _places(path) -> F.Column:
    """The places of a file that a definition may share with a call, as array<struct<near, place>>: itself, its folder, and
    everything below each of its parents. The nearer, the greater the number."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("near"), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")).alias("place")))
    own = F.array(F.struct(F.lit(1000).alias("near"), path.alias("place")), F.struct(F.lit(900).alias("near"), F.regexp_replace(path, "[^/]*$", "").alias("place")))
    return F.concat(own, below)


def resolve_calls(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(call_id, id) for calls (call_id, callee, source_file) with one definition (id, label, source_file) of that name in the
    same language family, or one that is nearest: in the same file, folder, or with the longest common path.

    Definitions are counted by name and place, calls look their places up: however many calls and definitions share a name,
    no pairs of them are made.
    """
    fam = lambda c: family(F.col(c))
    d = spread(defs, "id").select("id", F.col("label").alias("callee"), F.explode(F.array(F.coalesce(fam("source_file"), F.lit("none")), F.lit("any"))).alias("fam"), "source_file")
    d = d.select("id", "callee", "fam", F.explode(_places(F.col("source_file"))).alias("p"))
    d = d.groupBy("callee", "fam", "p.near", "p.place").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    c = calls.select("callee", "source_file").distinct()
    look = F.when(fam("source_file").isNull(), F.array(F.lit("any"))).otherwise(F.array(fam("source_file"), F.lit("none")))
    c = c.select("callee", "source_file", F.explode(look).alias("fam")).select("callee", "source_file", "fam", F.explode(_places(F.col("source_file"))).alias("p"))
    c = c.select("callee", "source_file", "fam", "p.near", "p.place")
    best = c.join(d, ["callee", "fam", "near", "place"]).groupBy("callee", "source_file", "near").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    best = best.groupBy("callee", "source_file").agg(F.max_by(F.struct("near", "n", "id"), F.col("near")).alias("b")).select("callee", "source_file", "b.*")
    best = materialise(best, "best")  # its size is known then: names are few beside calls, which need not be sorted by them
    # rows of one call_id are one call
    rows = calls.select("call_id", "callee", "source_file").join(best, ["callee", "source_file"])
    rows = spread(rows.select("call_id", "near", "n", "id"), "call_id").groupBy("call_id", "near").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    return rows.groupBy("call_id").agg(F.max_by(F.struct("n", "id"), F.col("near")).alias("b")).filter("b.n = 1").select("call_id", "b.id")


def rewire_stubs(nodes: DataFrame) -> DataFrame:
    """(stub, id): nodes without a source file to the only definition whose label has the same letters and digits."""
    key = F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}]", "")
    n = nodes.withColumn("key", key)
    real = n.filter("coalesce(source_file, '') <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1 AND key <> ''")
    return n.filter("coalesce(source_file, '') = ''").select(F.col("id").alias("stub"), "key").join(real, "key").select("stub", "id")


def split_collisions(nodes: DataFrame) -> DataFrame:
    """(id, source_file, new_id): ids that several files define get the file into the id."""
    n = nodes.select("id", "source_file").distinct()
    many = n.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    slug = F.regexp_replace(F.regexp_replace(F.lower("source_file"), r"\.[a-z0-9]+$", ""), r"[^\p{L}\p{N}]+", "_")
    return n.join(many, "id").select("id", "source_file", F.concat_ws("_", slug, "id").alias("new_id"))


def merge_ghosts(nodes: DataFrame) -> DataFrame:
    """(ghost, id): nodes of another origin than the parser's to the only parsed node with their file and label."""
    parsed = nodes.filter("origin = 'ast'").groupBy("source_file", "label").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return nodes.filter("coalesce(origin, '') <> 'ast'").select(F.col("id").alias("ghost"), "source_file", "label").join(parsed, ["source_file", "label"]).filter("ghost <> id").select("ghost", "id")


def resolve_imported(calls: DataFrame, imports: DataFrame, defs: DataFrame) -> DataFrame:
    """(call_id, id): calls (call_id, callee, source_file) of names that their file imports (source_file, module, name, alias) from a
    module with one definition (module, name, id) of that name."""
    one = defs.groupBy("module", "name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    known = imports.select("source_file", "module", "name", F.coalesce("alias", "name").alias("callee")).distinct().join(one, ["module", "name"])
    known = known.groupBy("source_file", "callee").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return calls.select("call_id", "callee", "source_file").join(known, ["source_file", "callee"]).select("call_id", "id")


def follow_exports(exports: DataFrame, defs: DataFrame, rounds: int = 8) -> DataFrame:
    """(module, name, id): what modules export, through chains of up to `rounds` re-exports (module, name, from_module,
    from_name) to a definition (module, name, id). The nearest definition counts; a ring leads nowhere."""
    known = defs.groupBy("module", "name").agg(F.min("id").alias("id"))
    hop = exports.groupBy("module", "name").agg(F.min(F.struct("from_module", "from_name")).alias("f")).select("module", "name", "f.from_module", "f.from_name")
    open_ = hop.join(known.select("module", "name"), ["module", "name"], "left_anti")
    for _ in range(rounds):
        step = open_.join(known.select(F.col("module").alias("from_module"), F.col("name").alias("from_name"), "id"), ["from_module", "from_name"], "left")
        step = materialise(step, "exports")
        known = known.union(step.filter("id IS NOT NULL").select("module", "name", "id"))
        open_ = step.filter("id IS NULL").drop("id")
    return known


def resolve_symbols(relations: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of relations (document, src, symbol, relation) among symbols (document, symbol, id): the symbol of the same document,
    else the only one of that name, else a stub. Returns edges (src, dst, relation) and the stubs (id, label)."""
    same = symbols.groupBy("document", "symbol").agg(F.min("id").alias("same"))
    only = symbols.groupBy("symbol").agg(F.countDistinct("id").alias("n"), F.min("id").alias("only")).filter("n = 1").drop("n")
    stub = F.concat(F.lit("external_"), F.regexp_replace(F.regexp_replace(F.lower("symbol"), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""))
    e = relations.join(same, ["document", "symbol"], "left").join(only, "symbol", "left").withColumn("stub", F.coalesce("same", "only").isNull())
    e = e.select("src", F.coalesce("same", "only", stub).alias("dst"), "relation", "stub", "symbol")
    stubs = e.filter("stub").groupBy(F.col("dst").alias("id")).agg(F.min("symbol").alias("label"))
    return e.select("src", "dst", "relation").distinct(), stubs


def scip_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document, symbol, id, line) and (document, src, symbol, relation) of an index's documents (relative_path, symbols array of
    struct<symbol, relationships array of struct<symbol, is_implementation, is_reference, is_type_definition>, occurrences array of
    struct<range array<int>>>)."""
    sid = F.concat_ws("_", *[F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "") for c in (F.col("document"), F.col("s.symbol"))])
    s = documents.select(F.col("relative_path").alias("document"), F.explode("symbols").alias("s")).filter("s.symbol <> ''").withColumn("id", sid)
    line = F.try_element_at(F.try_element_at("s.occurrences", F.lit(1))["range"], F.lit(1)) + 1
    r = s.select("document", F.col("id").alias("src"), F.explode("s.relationships").alias("r"))
    kind = F.when(F.col("r.is_implementation"), "implements").when(F.col("r.is_type_definition"), "references_type").otherwise("references")
    return s.select("document", "s.symbol", "id", line.cast("long").alias("line")), r.select("document", "src", "r.symbol", kind.alias("relation"))
