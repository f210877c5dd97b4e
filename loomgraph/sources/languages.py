"""Declarations, imports, bases and calls of source files in many languages, and the graph they make.

A language is a row of patterns. Comments and strings are blanked first, so that lines and columns stay; a declaration belongs
to the nearest one above it that is indented less, whatever a language's blocks look like.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fast_id

FACTS = "path string, line long, kind string, name string, target string"


@dataclass(frozen=True)
class Language:
    """Patterns of one language: their first group is the name. bases: a list of names behind a class; comments: what opens one to
    the end of the line, and in pairs; keywords: what looks like a call and isn't."""

    endings: tuple[str, ...]
    types: str
    functions: str
    imports: str
    bases: str = ""
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    calls: str = r"([A-Za-z_][\w.:]*[!?]?)\s*\("
    strings_in_imports: bool = False


_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|partial|override|virtual|async|export|default|inline|const|unsafe|extern|global|with\s+sharing|without\s+sharing|synchronized|native|mutating|fileprivate)\s+)*"
_TYPE = r"[\w<>\[\],.?&*: ]+?"
_HASH = {"line_comments": ("#",), "block_comments": ()}
_C_FUNCTION = rf"^[ \t]*+{_MOD}(?!return\b|else\b|new\b|throw\b){_TYPE}[ \t*&]+~?(\w+)\s*\([^;{{}}]*\)[^;{{}}]*\{{"
LANGUAGES = {
    "javascript": Language(("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), rf"^[ \t]*{_MOD}(?:class|interface|enum|type)\s+(\w+)", rf"^[ \t]*{_MOD}(?:function\*?\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>|(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(\w+)\s*\([^;{{}}]*\)\s*(?::[^{{;]+)?\{{)", r"^[ \t]*(?:import\b[^'\"\n]*|export\b[^'\"\n]*\bfrom\s*|.*\brequire\s*\(\s*)['\"]([^'\"]+)['\"]", r"(?:extends|implements)\s+([\w., <>]+)", quotes="\"'`", strings_in_imports=True),
    "java": Language(("java",), rf"^[ \t]*{_MOD}(?:class|interface|enum|record)\s+(\w+)", rf"^[ \t]*+{_MOD}(?:<[^>]+>\s*)?(?!return\b|else\b|new\b|throw\b)(?:[\w<>\[\],.? ]+\s(\w+)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?[{{;]|(\w+)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\{{)", r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)", r"(?:extends|implements)\s+([\w., <>]+)"),
    "groovy": Language(("groovy", "gradle"), rf"^[ \t]*{_MOD}(?:class|interface|enum|trait)\s+(\w+)", rf"^[ \t]*{_MOD}(?:def|void|[\w<>\[\]]+)\s+(\w+)\s*\([^;{{}}]*\)\s*\{{", r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)", r"(?:extends|implements)\s+([\w., <>]+)"),
    "c": Language(("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "cu", "cuh", "metal"), r"^[ \t]*(?:typedef\s+)?(?:class|struct|enum|union|namespace)\s+(?:class\s+)?(\w+)[^;()]*\{", _C_FUNCTION, r"^[ \t]*#\s*include\s*[<\"]([^>\"]+)[>\"]", r":\s*((?:public|private|protected|virtual|\s|[\w:<>,])+)\{", strings_in_imports=True),
    "csharp": Language(("cs",), rf"^[ \t]*{_MOD}(?:class|interface|struct|enum|record|namespace)\s+([\w.]+)", rf"^[ \t]*+{_MOD}(?!return\b|else\b|new\b|throw\b|await\b)(?:[\w<>\[\],.? ]+\s)(\w+)\s*\([^;{{}}]*\)\s*(?:\{{|=>)", r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;", r"(?<!:):\s*([\w., <>]+)"),
    "kotlin": Language(("kt", "kts"), rf"^[ \t]*{_MOD}(?:enum\s+class|class|interface|object)\s+(\w+)", rf"^[ \t]*{_MOD}(?:suspend\s+)?fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(\w+)", r"^[ \t]*import\s+([\w.*]+)", r":\s*([\w., <>()]+?)\s*\{"),
    "scala": Language(("scala",), rf"^[ \t]*{_MOD}(?:case\s+)?(?:class|object|trait)\s+(\w+)", rf"^[ \t]*{_MOD}(?:implicit\s+)?def\s+(\w+)", r"^[ \t]*import\s+([\w.{}, _=>*]+)", r"(?:extends|with)\s+([\w.\[\]]+)"),
    "php": Language(("php",), rf"^[ \t]*{_MOD}(?:class|interface|trait|enum)\s+(\w+)", rf"^[ \t]*{_MOD}function\s+&?(\w+)", r"^[ \t]*(?:use\s+(?:function\s+)?([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"])", r"(?:extends|implements)\s+([\w\\, ]+)", line_comments=("//", "#"), strings_in_imports=True),
    "ruby": Language(("rb", "rake"), r"^[ \t]*(?:class|module)\s+([\w:]+)", r"^[ \t]*def\s+(?:self\.)?([\w?!=]+)", r"^[ \t]*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"<\s*([\w:]+)", strings_in_imports=True, **_HASH),
    "lua": Language(("lua",), r"^[ \t]*(?:local\s+)?([A-Z]\w*)\s*=\s*(?:setmetatable\s*\(|\{\s*\})", r"^[ \t]*(?:local\s+)?function\s+([\w.:]+)", r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", line_comments=("--",), block_comments=(("--[[", "]]"),), strings_in_imports=True),
    "swift": Language(("swift",), rf"^[ \t]*{_MOD}(?:class|struct|enum|protocol|extension|actor)\s+(\w+)", rf"^[ \t]*{_MOD}func\s+(\w+)", r"^[ \t]*import\s+([\w.]+)", r":\s*([\w., <>]+?)\s*\{"),
    "go": Language(("go",), r"^[ \t]*type\s+(\w+)\s+(?:struct|interface)\b", r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(\w+)\s*[(\[]", r"^[ \t]*(?:import\s+)?(?:\w+\s+|\.\s+|_\s+)?\"([^\"\n]+)\"\s*$", strings_in_imports=True, quotes="\"'`"),
    "rust": Language(("rs",), r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:struct|enum|trait|union|mod)\s+(\w+)|impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+))", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(\w+)", r"^[ \t]*(?:pub\s+)?use\s+([\w:{}, *]+)", r"(?<=\w):\s*([\w+ ]+?)\s*\{", quotes='"'),
    "zig": Language(("zig",), r"^[ \t]*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?(?:struct|enum|union|opaque)\b", r"^[ \t]*(?:pub\s+|export\s+|inline\s+)*fn\s+(\w+)", r"@import\(\s*\"([^\"]+)\"", quotes='"', block_comments=(), strings_in_imports=True),
    "elixir": Language(("ex", "exs"), r"^[ \t]*(?:defmodule|defprotocol)\s+([\w.]+)", r"^[ \t]*(?:def|defp|defmacro)\s+([\w?!]+)", r"^[ \t]*(?:alias|import|use|require)\s+([\w.]+)", **_HASH),
    "julia": Language(("jl",), r"^[ \t]*(?:abstract\s+type|mutable\s+struct|struct|module)\s+(\w+)", r"^[ \t]*(?:function\s+([\w.!]+)|([\w!]+)\([^()\n]*\)\s*=(?!=))", r"^[ \t]*(?:using|import)\s+([\w., :]+)", r"<:\s*(\w+)", line_comments=("#",), block_comments=(("#=", "=#"),)),
    "fortran": Language(("f", "f90", "f95", "f03", "f08", "for"), r"(?i)^[ \t]*(?:module(?!\s+procedure)|program|type(?:\s*,[^:\n]*)?(?:\s*::)?)\s+(?!\()(\w+)", r"(?i)^[ \t]*(?:(?:pure|elemental|recursive|integer|real|logical|character|complex)(?:\([^)]*\))?\s+)*(?:subroutine|function)\s+(\w+)", r"(?i)^[ \t]*use\s+(?:,\s*\w+\s*::\s*)?(\w+)", line_comments=("!",), block_comments=(), calls=r"(?i)\bcall\s+(\w+)"),
    "objectivec": Language(("m", "mm"), r"^[ \t]*@(?:interface|implementation|protocol)\s+(\w+)", r"^[ \t]*[-+]\s*\([^)]*\)\s*(\w+)", r"^[ \t]*[#@]import\s*[<\"]?([\w./]+)", r":\s*(\w+)", strings_in_imports=True, calls=r"\[\s*\w+\s+(\w+)"),
    "dart": Language(("dart",), rf"^[ \t]*{_MOD}(?:class|mixin|enum|extension)\s+(\w+)", rf"^[ \t]*+{_MOD}(?!return\b|else\b|new\b|await\b)(?:[\w<>\[\],.? ]+\s)?(\w+)\s*\([^;{{}}]*\)\s*(?:async\s*)?(?:\{{|=>)", r"^[ \t]*(?:import|export|part)\s+['\"]([^'\"]+)['\"]", r"(?:extends|implements|with|on)\s+([\w, <>]+)", strings_in_imports=True),
    "verilog": Language(("v", "sv", "svh"), r"^[ \t]*(?:module|interface|class|package)\s+(\w+)", r"^[ \t]*(?:virtual\s+|static\s+)*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]: ]+\s)?(\w+)\s*[(;]", r"^[ \t]*(?:`include\s+\"([^\"]+)\"|import\s+(\w+)::)", r"extends\s+(\w+)", quotes='"', strings_in_imports=True),
    "powershell": Language(("ps1", "psm1"), r"(?i)^[ \t]*(?:class|enum)\s+(\w+)", r"(?i)^[ \t]*function\s+([\w:-]+)", r"(?i)^[ \t]*(?:import-module|using\s+module)\s+['\"]?([\w./\\-]+)", r":\s*(\w+)", line_comments=("#",), block_comments=(("<#", "#>"),), calls=r"(?m)(?:^[ \t]*|\|\s*|=\s*)([A-Z]\w+-\w+)", strings_in_imports=True),
    "bash": Language(("sh", "bash", "zsh"), r"(?!)()", r"^[ \t]*(?:function\s+([\w:-]+)|([\w:-]+)\s*\(\s*\))", r"^[ \t]*(?:source|\.)\s+[\"']?([^\s\"';]+)", calls=r"(?m)^[ \t]*([a-z_][\w-]*)(?=\s|$)", strings_in_imports=True, **_HASH),
    "apex": Language(("cls", "trigger"), rf"(?i)^[ \t]*{_MOD}(?:class|interface|enum|trigger)\s+(\w+)", rf"(?i)^[ \t]*+{_MOD}(?!return\b|else\b|new\b|throw\b)(?:[\w<>\[\],. ]+\s)(\w+)\s*\([^;{{}}]*\)\s*\{{", r"(?!)()", r"(?i)(?:extends|implements)\s+([\w., <>]+)"),
    "pascal": Language(("pas", "pp", "dpr", "lpr"), r"(?i)^[ \t]*(?:unit|program|(\w+)\s*=\s*(?:class|record|interface))\b\s*(\w*)", r"(?i)^[ \t]*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+([\w.]+)", r"(?i)\buses\s+([\w., \n]+);", r"(?i)class\s*\(([\w, ]+)\)", line_comments=("//",), block_comments=(("{", "}"), ("(*", "*)")), quotes="'"),
    "terraform": Language(("tf", "hcl"), r"^[ \t]*(?:resource|data|module|variable|output|provider)\s+\"([\w-]+)\"", r"(?!)()", r"^[ \t]*source\s*=\s*\"([^\"]+)\"", line_comments=("#", "//"), strings_in_imports=True),
}
ENDING = {e: name for name, x in LANGUAGES.items() for e in x.endings}
NOT_CALLS = frozenset("async if for while switch catch return function func fn def class new sizeof typeof match when unless elsif elif until foreach lock using with and or not in is as throw raise await yield assert super this self then do done fi esac case else end local export set echo cd test exit shift read unset declare begin".split())

CONTROL = frozenset("if for while switch catch return else do match when unless foreach lock using function sizeof typeof await throw".split())


@lru_cache(maxsize=64)
def _compiled(name: str):
    x = LANGUAGES[name]
    return x, *(re.compile(p, re.M) for p in (x.types, x.functions, x.imports, x.bases or r"(?!)()", x.calls))


def blanked(text: str, x: Language, strings: bool) -> str:
    """text with comments, and if asked for the insides of strings, as blanks; line ends stay. One pass over the text."""
    marks = [re.escape(a) for a, _ in x.block_comments] + [re.escape(c) for c in x.line_comments] + [re.escape(q) for q in x.quotes]
    ends = dict(x.block_comments)
    opener = re.compile("|".join(sorted(marks, key=len, reverse=True)))
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    out, at = [], 0
    for_quote = {q: re.compile(rf"(?:\\.|[^\\{q}])*{q}" if q == "`" else rf"(?:\\.|[^\\{q}\n])*{q}", re.S) for q in x.quotes}
    while m := opener.search(text, at):
        out.append(text[at : m.start()])
        mark = m[0]
        if mark in ends:
            end = text.find(ends[mark], m.end())
            stop = len(text) if end < 0 else end + len(ends[mark])
            out.append(blank(text[m.start() : stop]))
        elif mark in for_quote:
            q = for_quote[mark].match(text, m.end())
            stop = q.end() if q else m.end()
            out.append(mark + blank(text[m.end() : stop - 1]) + mark if q and strings else text[m.start() : stop])
        else:
            end = text.find("\n", m.end())
            stop = len(text) if end < 0 else end
            out.append(blank(text[m.start() : stop]))
        at = stop
    return "".join(out) + text[at:]


def facts(text: str, language: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, name, target): class, function and method (target: the owner), inherits, imports, calls (name: the caller)."""
    x, types, functions, imports, bases, calls = _compiled(language)
    code = blanked(text, x, True)
    named = code if not x.strings_in_imports else blanked(text, x, False)
    starts = [0]
    for m in re.finditer("\n", code):
        starts.append(m.end())

    def line_of(at: int) -> int:
        lo, hi = 0, len(starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= at else (lo, mid)
        return lo + 1

    first = lambda m: next((g for k, g in enumerate(m.groups(), 1) if g and k != m.re.groupindex.get("owner")), "")
    indent = lambda at: len(re.match(r"[ \t]*", code[starts[line_of(at) - 1] :]).group().expandtabs(4)) if at < len(code) else 0
    found: list[tuple[int, int, str, str, int]] = []  # place, indent, kind, name, end
    heads = named if language == "terraform" else code
    for m in types.finditer(heads):
        if name := first(m):
            found.append((m.start(), indent(m.start()), "class", name, m.end()))
    taken = {line_of(p) for p, *_ in found}
    for m in functions.finditer(code):
        name = first(m)
        if name and name not in CONTROL and line_of(m.start()) not in taken:
            owner = m.groupdict().get("owner")
            found.append((m.start(), indent(m.start()), "function", f"{owner}.{name}" if owner else name, m.end()))
    found.sort()
    out: list[tuple[int, str, str, str]] = []
    open_: list[tuple[int, str, str]] = []
    spans: list[tuple[int, int, str]] = []
    for place, depth, kind, name, end in found:
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        owner = next((n for _, k, n in reversed(open_) if k == "class"), "")
        if kind == "function" and not owner and (cut := re.match(r"(.+)[.:](\w+)$", name)):
            owner, name = cut[1], cut[2]
        out.append((line_of(place), "method" if kind == "function" and owner else kind, name, owner))
        if kind == "class" and x.bases:
            stop = code.find("\n", end)
            for b in bases.finditer(code, max(place, end - 1), stop if stop >= 0 else len(code)):
                for base in re.split(r"[,+]|\bwith\b", re.sub(r"<[^>]*>|\([^)]*\)|\[[^\]]*\]|\b(?:public|private|protected|virtual|implements|extends)\b", lambda m: "," if m[0] in ("implements", "extends") else "", b[1])):
                    if base := base.strip():
                        out.append((line_of(place), "inherits", name, base))
        open_.append((depth, kind, name))
        if kind == "function":
            spans.append((place, depth, name))
    for m in imports.finditer(named):
        for name in re.split(r"\s*,\s*(?![^{]*\})", first(m)) if language in ("julia", "pascal") else [first(m)]:
            if name.strip():
                out.append((line_of(m.start()), "imports", "", re.sub(r"\s+", " ", name.strip().rstrip(":"))))
    declared = {(line, n) for line, k, n, _ in out if k in ("function", "method", "class")}
    k = 0
    current: list[tuple[int, str]] = []
    seen = set()
    for m in calls.finditer(code):
        name, at = first(m), m.start(1)
        while k < len(spans) and spans[k][0] <= at:
            place, depth, fn = spans[k]
            while current and current[-1][0] >= depth:
                current.pop()
            current.append((depth, fn))
            k += 1
        here, line = indent(at), line_of(at)
        inside = [fn for depth, fn in current if depth < here or line_of(spans[k - 1][0]) == line]
        last = re.split(r"[.:]+", name)[-1]
        if not inside or last in NOT_CALLS or (line, last) in declared or (line, name) in declared:
            continue
        if (inside[-1], name) not in seen:
            seen.add((inside[-1], name))
            out.append((line, "calls", inside[-1], name))
    return sorted(set(out))


def extract(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, target) of files (path, text) in the languages above, by their endings; others give no rows.
    Null and empty texts give none; a file is read whole by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *f) for p, t in zip(b["path"], b["text"]) if t and (x := ENDING.get(p.rsplit(".", 1)[-1].lower())) for f in facts(t, x)]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "name", "target"])

    return files.select("path", "text").dropna(subset=["path"]).mapInPandas(run, FACTS)


def symbol_id(path: Column, name: Column) -> Column:
    return fast_id(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), name)


def to_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, file_type, source_file, line) and edges (src, dst, relation, confidence, source_file) of facts: a node for
    each file, type and function; files contain types and functions, types have methods. Imports and bases point to ids of
    modules and names, calls to functions of the same file; all else is left to name resolution."""
    stem = fast_id(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""))
    name = F.element_at(F.split("path", "/"), -1)
    files = found.select("path").distinct().select(stem.alias("id"), name.alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), F.lit(1).cast("long").alias("line"))
    label = F.when(F.col("kind") == "class", F.col("name")).when(F.col("kind") == "method", F.concat(F.lit("."), "name", F.lit("()"))).otherwise(F.concat("name", F.lit("()")))
    own = F.when(F.col("kind") == "method", F.concat_ws("_", "target", "name")).otherwise(F.col("name"))
    made = found.filter("kind IN ('class', 'function', 'method')").select(symbol_id(F.col("path"), own).alias("id"), label.alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), "line", "kind", "name", "target")
    nodes = files.union(made.groupBy("id").agg(F.min(F.struct("line", "label", "file_type", "source_file")).alias("x")).select("id", "x.label", "x.file_type", "x.source_file", "x.line"))
    edge = lambda df, src, dst, relation, sure: df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(sure).alias("confidence"), F.col("path").alias("source_file"))
    here = found.withColumnRenamed("target", "t").withColumn("file", stem)
    contains = edge(here.filter("kind IN ('class', 'function')"), F.col("file"), symbol_id(F.col("path"), F.col("name")), "contains", "EXTRACTED")
    method = edge(here.filter("kind = 'method'"), symbol_id(F.col("path"), F.col("t")), symbol_id(F.col("path"), F.concat_ws("_", "t", "name")), "method", "EXTRACTED")
    imports = edge(here.filter("kind = 'imports'"), F.col("file"), fast_id(F.col("t")), "imports", "EXTRACTED")
    inherits = edge(here.filter("kind = 'inherits'"), symbol_id(F.col("path"), F.col("name")), fast_id(F.col("t")), "inherits", "EXTRACTED")
    by_name = made.select(F.col("source_file").alias("path"), "name", "id").distinct()
    one = by_name.groupBy("path", "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    c = found.filter("kind = 'calls'").select("path", F.col("name").alias("caller"), F.regexp_extract("target", r"([^.:]+)$", 1).alias("callee"))
    c = c.join(one.select("path", F.col("name").alias("caller"), F.col("id").alias("s")), ["path", "caller"]).join(one.select("path", F.col("name").alias("callee"), F.col("id").alias("t")), ["path", "callee"])
    calls = edge(c, F.col("s"), F.col("t"), "calls", "EXTRACTED")
    return nodes, contains.union(method).union(imports).union(inherits).union(calls).distinct()
