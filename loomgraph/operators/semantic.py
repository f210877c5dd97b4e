"""What language models say: JSON in free text, relations between nodes, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_id
from ..sources.storage import materialise, spread
from .claims import GROUPS

# Relations that a model may state, how sure it may be, and what it may claim.
RELATIONS = ("handles", "validates", "manages", "responsible_for", "related_to")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
CLAIM_TYPES = ("exists", "calls", "imports", "inherits", "method_of", "relation")
MOST_RELATIONS, MOST_SECONDARY = 200, 8
FENCE = r"(?is)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"


def json_blob(text: Column) -> Column:
    """The first of these that is JSON: fenced blocks, the last one first; the whole text; what begins at the first brace."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    brace = F.locate("{", raw)
    candidates = F.concat(F.reverse(F.regexp_extract_all(raw, F.lit(FENCE), 1)), F.array(raw, F.when(brace > 0, F.substring(raw, brace, F.length(raw)))))

    def alone(x: Column) -> Column:
        """As the only member of a list, for the parser doesn't look at what follows a value."""
        listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        return listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()

    return F.try_element_at(F.filter(candidates, lambda x: x.isNotNull() & (x != "") & alone(x)), F.lit(1))


def parse_relations(responses: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(response_id, place, src, relation, dst, confidence, rationale) of responses (response_id, text) with a list of relations,
    and the concept nodes (id, label) they need. Of each response the first MOST_RELATIONS count; unknown kinds, missing
    ends and loops go. An end is the node with that id, or with its normal form, else a new concept."""
    kind = "struct<relations:array<struct<source:string,relation:string,target:string,confidence:string,rationale:string>>>"
    r = spread(responses, "response_id").select("response_id", F.from_json(json_blob(F.col("text")), kind).alias("j")).select("response_id", F.posexplode(F.slice("j.relations", 1, MOST_RELATIONS)).alias("place", "r"))
    r = r.select("response_id", F.col("place").cast("long").alias("place"), F.trim("r.source").alias("source"), F.lower(F.trim("r.relation")).alias("relation"), F.trim("r.target").alias("target"), F.upper(F.trim("r.confidence")).alias("confidence"), F.substring("r.rationale", 1, 280).alias("rationale"))
    r = r.filter((F.col("source") != "") & (F.col("target") != "") & F.col("relation").isin(*RELATIONS))
    r = r.withColumn("confidence", F.when(F.col("confidence").isin(*CONFIDENCES), F.col("confidence")).otherwise("INFERRED"))
    r = materialise(r, "relations")  # parsed once, over all tasks, though ends and rows are looked at apart
    names = r.select(F.col("source").alias("name")).union(r.select("target")).distinct().withColumn("normal", normal_id(F.col("name")))
    known = nodes.select("id").distinct()
    names = names.join(known.select(F.col("id").alias("exact")), F.col("name") == F.col("exact"), "left").join(known.select(F.col("id").alias("like")), F.col("normal") == F.col("like"), "left")
    concept = F.concat(F.lit("concept_"), F.when(F.col("normal") != "", F.col("normal")).otherwise("unknown"))
    names = names.select("name", F.coalesce("exact", "like", concept).alias("id"), F.coalesce("exact", "like").isNull().alias("new"))
    end = lambda c, to: names.select(F.col("name").alias(c), F.col("id").alias(to))
    r = r.join(end("source", "src"), "source").join(end("target", "dst"), "target").filter("src <> dst")
    used = r.select(F.col("source").alias("name"), F.col("src").alias("id")).union(r.select("target", "dst"))
    concepts = used.join(names.filter("new").select("name"), "name", "left_semi").groupBy("id").agg(F.min("name").alias("label"))
    return r.select("response_id", "place", "src", "relation", "dst", "confidence", "rationale"), concepts


def apply_relations(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """edges (src, dst, relation, secondary array<string>) after relations (seq, src, dst, relation): one between joined nodes, in
    either direction, becomes a secondary one of their edge, each kind once and MOST_SECONDARY at most; for others a new edge
    is made by the first relation of the pair."""
    pair = lambda df: df.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    r = pair(relations).groupBy("a", "b", "relation").agg(F.min(F.struct("seq", "src", "dst")).alias("first"))
    e = pair(edges)
    carrier = e.groupBy("a", "b").agg(F.min(F.struct("src", "dst", "relation")).alias("c"))
    first = r.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("first.seq", "relation")))  # a pair has a row for each kind
    new = first.join(carrier, ["a", "b"], "left_anti").filter("n = 1").select("a", "b", "first.src", "first.dst", "relation", F.array().cast("array<string>").alias("secondary"))
    base = e.unionByName(new.select("src", "dst", "relation", "secondary", "a", "b"))
    carrier = base.groupBy("a", "b").agg(F.min(F.struct("src", "dst", "relation")).alias("c"))
    more = r.join(carrier, ["a", "b"]).join(new.select("a", "b", F.col("relation").alias("made")), ["a", "b"], "left").filter("made IS NULL OR made <> relation")
    more = more.groupBy("a", "b", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("first.seq", "relation"))), lambda x: x["relation"]).alias("more"))
    out = base.join(more.select("c.src", "c.dst", "c.relation", "more"), ["src", "dst", "relation"], "left")
    have = F.coalesce("secondary", F.array().cast("array<string>"))
    return out.select("src", "dst", "relation", F.slice(F.concat(have, F.array_except(F.coalesce("more", F.array().cast("array<string>")), have)), 1, MOST_SECONDARY).alias("secondary"))


def parse_claims(responses: DataFrame) -> DataFrame:
    """(response_id, place, type, source, target, relation) of responses with claims: a list, or an object with `claims`. A relation
    as type stands for its kind of claim; other names of the ends are taken; claims without an end they need go."""
    fields = ("type", "claim_type", "source", "target", "relation", "symbol", "name", "owner", "class", "method", "caller", "callee", "from", "to")
    item = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    blob = json_blob(F.col("text"))
    both = F.coalesce(F.from_json(blob, f"struct<claims:{item}>")["claims"], F.from_json(F.when(F.startswith(F.trim(blob), F.lit("[")), blob), item))
    c = responses.select("response_id", F.posexplode(both).alias("place", "c"))
    field = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("c").getField(n)), F.lit("")) for n in names])
    said = F.lower(F.coalesce(field("type", "claim_type"), F.lit("")))
    kind = F.when(said.isin(*CLAIM_TYPES), said)
    for name, relations in GROUPS.items():
        if name != "method_of":
            kind = kind.when(said.isin(*relations), name)
    kind = kind.when(said != "", "relation")
    source = F.when(kind == "exists", field("symbol", "name", "source")).when(kind == "method_of", field("source", "owner", "class")).otherwise(field("source", "caller", "from"))
    target = F.when(kind == "exists", F.lit(None).cast("string")).when(kind == "method_of", field("target", "method", "name")).otherwise(field("target", "callee", "to"))
    relation = F.when(said.isin(*CLAIM_TYPES), F.when(~kind.isin("exists", "method_of"), field("relation"))).otherwise(said)
    out = c.select("response_id", F.col("place").cast("long").alias("place"), kind.alias("type"), source.alias("source"), target.alias("target"), relation.alias("relation"))
    return out.filter((F.col("type") == "exists") & F.col("source").isNotNull() | (F.col("type") != "exists") & F.col("source").isNotNull() & F.col("target").isNotNull())


def proposal_verdicts(verdicts: DataFrame, strict: bool = False) -> DataFrame:
    """(proposal, verdict, blocked) for the verdicts (proposal, verdict) of the references in proposed code; strict blocks what a
    graph contradicts, and nothing else."""
    from .claims import roll_up

    return roll_up(verdicts, "proposal").withColumn("blocked", F.lit(strict) & (F.col("verdict") == "CONTRADICTED"))
