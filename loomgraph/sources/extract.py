"""Sources to rows: file classes, scans against a manifest, HTML, Markdown, Python, slices."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What an academic text shows, three of which are enough.
PAPER_SIGNS = (r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b")
CODE = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "c", "h", "cpp", "cc", "cs", "rb", "php", "swift", "kt", "scala", "lua", "sh", "sql")
PROSE = ("md", "txt", "rst", "html", "adoc")


def file_class(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin(*CODE), "code").when(end.isin(*PROSE), "document").when(end == "pdf", "paper").when(end.isin("png", "jpg", "jpeg", "gif", "svg", "webp"), "image").when(end.isin("mp4", "mov", "mkv", "webm"), "video")


def looks_like_paper(text: Column, least: int = 3) -> Column:
    head = F.substring(text, 1, 3000)
    return sum((F.rlike(head, F.lit(s)).cast("int") for s in PAPER_SIGNS), F.lit(0)) >= least


# Folders of credentials; folders that may hold them; names of files that do; words that say so; endings of data.
CREDENTIAL_DIRS = (".ssh", ".gnupg", ".aws", ".gcloud")
MAYBE_DIRS = ("secrets", ".secrets", "credentials")
SECRET_NAMES = (
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)^secring(\.(gpg|pgp))?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$",
)
SECRET_WORDS = (r"(credential|secret|passwd|password|private_key)s?", r"tokens?", r"service[._-]?account")
NOTES = ("md", "markdown", "rst", "org", "adoc", "tex")
DATA = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "config", "xml", "properties", "env", "txt", "tfvars")


def is_secret(path: Column) -> Column:
    """Stores of secrets: by folder, by name, or by a secret word at the end of the stem or in one of at most two words; source
    code isn't one for its folder or words, nor are notes for their words, unless the stem is just that word."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    end = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    source = (F.coalesce(file_class(path), F.lit("")) == "code") & ~end.isin(*DATA)
    bare = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""), r"^\.+", "")
    few = F.size(F.filter(F.split(bare, r"[-_\s.]+"), lambda x: x != "")) <= 2
    word = [rf"(?i)(?<![a-zA-Z0-9]){w}(?![a-zA-Z])" for w in SECRET_WORDS]
    any_of = lambda patterns: reduce(lambda a, b: a | b, patterns)
    said = any_of([bare.rlike(w + "$") | (few & bare.rlike(w)) for w in word])
    note = end.isin(*NOTES) & ~any_of([bare.rlike(f"^{w}$") for w in word])
    in_store = F.arrays_overlap(folders, F.array(*map(F.lit, CREDENTIAL_DIRS)))
    maybe = F.arrays_overlap(folders, F.array(*map(F.lit, MAYBE_DIRS))) & ~source
    return F.coalesce(in_store | maybe | any_of([name.rlike(p) for p in SECRET_NAMES]) | (said & ~source & ~note), F.lit(False))


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, mtime, size, kind, words) of all files below root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    text = F.decode("content", "UTF-8")
    return f.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), file_class(F.col("path")).alias("kind"), F.regexp_count(text, F.lit(r"\S+")).alias("words"))


def scan_status(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of path and hash in both: new, changed, unchanged or deleted."""
    a, b = now.select("path", F.col("hash").alias("h")), manifest.select("path", F.col("hash").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("h").isNull(), "deleted").when(F.col("h") == F.col("old"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_plain(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space as single spaces."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def url_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(F.contains(low, F.lit("arxiv.org")), "paper").when(F.contains(low, F.lit("github.com")), "repository").when(low.rlike(r"\.pdf($|[?#])"), "pdf").when(low.rlike(r"\.(png|jpe?g|gif|webp)($|[?#])"), "image").when(low.rlike(r"[?&]page="), "listing").otherwise("webpage")


def lines_outside_fences(docs: DataFrame) -> DataFrame:
    """(doc_id, line, x) of the lines of Markdown texts that stand in no fenced block. Fences are counted within each text's
    array of lines, so nothing is shuffled."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    fence = lambda x: F.rlike(x, F.lit(r"^\s*(```|~~~)"))
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<line:int,x:string>>").alias("out"), F.lit(0).alias("k"))

    def step(s, x):
        keep = ~s["inside"] & ~fence(x)
        out = F.when(keep, F.concat(s["out"], F.array(F.struct((s["k"] + 1).alias("line"), x.alias("x"))))).otherwise(s["out"])
        return F.struct((s["inside"] != fence(x)).alias("inside"), out.alias("out"), (s["k"] + 1).alias("k"))

    flagged = docs.filter(F.contains("text", F.lit("```")) | F.contains("text", F.lit("~~~"))).select("doc_id", F.explode(F.aggregate(lines, state, step, lambda s: s["out"])).alias("r")).select("doc_id", "r.line", "r.x")
    plain = docs.filter(~(F.contains("text", F.lit("```")) | F.contains("text", F.lit("~~~")))).select("doc_id", F.posexplode(lines).alias("line", "x"))
    return plain.select("doc_id", (F.col("line") + 1).alias("line"), "x").union(flagged)


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, title) of Markdown headings outside fenced blocks."""
    line = lines_outside_fences(docs)
    return line.filter(F.col("x").rlike(r"^#{1,6} +\S")).select("doc_id", F.col("line").cast("long").alias("line"), F.length(F.regexp_extract("x", r"^(#+)", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("x", r"^#+ +", "")).alias("title"))


def markdown_links(docs: DataFrame) -> DataFrame:
    """(doc_id, target) of links to other documents outside fenced blocks: no addresses, no anchors of the same text."""
    found = lines_outside_fences(docs).select("doc_id", F.explode(F.regexp_extract_all("x", F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)).alias("t"))
    target = F.regexp_replace(F.col("t"), r"[#?].*$", "")
    return found.select("doc_id", target.alias("target")).filter((F.col("target") != "") & ~F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")).distinct()


def cut(text: str, most: int) -> list[tuple[int, int]]:
    """Gap-free slices of up to `most` characters that end before a heading, else after a blank line, a line, or anywhere."""
    out, at = [], 0
    while len(text) - at > most:
        part = text[at : at + most]
        k = part.rfind("\n#", 1)
        end = k + 1 if k > 0 else 0
        for sep in ("\n\n", "\n"):
            if not end and (k := part.rfind(sep)) > 0:
                end = k + len(sep)
        out.append((at, at + (end or most)))
        at += end or most
    out.append((at, len(text)))
    return out


def slices(docs: DataFrame, most: int = 2000) -> DataFrame:
    """(doc_id, part, start, end) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, s, e) for d, t in zip(b["doc_id"], b["text"]) for k, (s, e) in enumerate(cut(t or "", most))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "start", "end"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, part bigint, start bigint, end bigint")


def python_facts(source: str) -> list[tuple[str, str, str]]:
    """(kind, name, target) of classes, functions, methods, bases, imports and calls in Python source; a syntax error is a fact."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return [("error", "", "")]
    out = []

    def name_of(x) -> str:
        return x.id if isinstance(x, ast.Name) else f"{name_of(x.value)}.{x.attr}" if isinstance(x, ast.Attribute) else ""

    def visit(node, owner: str) -> None:
        for c in ast.iter_child_nodes(node):
            here = owner
            if isinstance(c, ast.ClassDef):
                out.append(("class", c.name, owner))
                out.extend(("inherits", c.name, name_of(b)) for b in c.bases if name_of(b))
                here = c.name
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("method" if isinstance(node, ast.ClassDef) else "function", c.name, owner))
                here = f"{owner}.{c.name}" if owner else c.name
            elif isinstance(c, ast.Import):
                out.extend(("imports", owner, a.name) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                out.extend(("imports_from", owner, f"{'.' * c.level}{c.module or ''}.{a.name}") for a in c.names)
            elif isinstance(c, ast.Call) and name_of(c.func):
                out.append(("calls", owner, name_of(c.func)))
            visit(c, here)

    visit(tree, "")
    return out


def extract_python(files: DataFrame) -> DataFrame:
    """(path, kind, name, target) of Python files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *f) for p, t in zip(b["path"], b["text"]) for f in python_facts(t)], columns=["path", "kind", "name", "target"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, target string")


def extract_sql(files: DataFrame) -> DataFrame:
    """(path, kind, name, target) of DDL (path, text), by patterns in the JVM: tables, views, functions, triggers; foreign keys,
    also of ALTER TABLE; what views and functions read from, and the table a trigger is on."""
    name = r"[\w.\"`\[\]]+"
    head = rf"(?is)(?:create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?|(alter\s+table)\s+(?:only\s+)?(?:if\s+exists\s+)?)({name})"
    clean = lambda c: F.lower(F.regexp_replace(c, r"[\"`\[\]]", ""))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)--[^\n]*|/\*.*?\*/", " ")
    part = files.select("path", F.explode(F.split(text, r"(?i)(?=\b(?:create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(?:table|view|function|procedure|trigger)|alter\s+table)\b)")).alias("ddl"))
    part = part.filter(F.col("ddl").rlike(r"(?is)^\s*(?:create|alter)\s")).select(
        "path", "ddl", F.lower(F.coalesce(F.nullif(F.regexp_extract("ddl", head, 1), F.lit("")), F.lit("alter"))).alias("kind"), clean(F.regexp_extract("ddl", head, 3)).alias("name")
    ).filter("name <> ''")
    made = part.filter("kind <> 'alter'").select("path", "kind", "name", F.lit("").alias("target"))
    refs = part.filter("kind IN ('table', 'alter')").select("path", F.lit("references").alias("kind"), "name", F.explode(F.regexp_extract_all("ddl", F.lit(rf"(?is)references\s+({name})"), 1)).alias("target"))
    reads = part.filter("kind IN ('view', 'function', 'procedure')").select("path", F.lit("reads_from").alias("kind"), "name", F.explode(F.regexp_extract_all("ddl", F.lit(rf"(?is)\b(?:from|join)\s+({name})"), 1)).alias("target"))
    on = part.filter("kind = 'trigger'").select("path", F.lit("triggers").alias("kind"), "name", F.regexp_extract("ddl", rf"(?is)\bon\s+({name})", 1).alias("target"))
    return made.union(refs.union(reads).union(on).select("path", "kind", "name", clean(F.col("target")).alias("target")).filter("target <> ''").distinct())
