"""Registered queries: facts of source files in each language, the graph they make, and how names are resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution
from ..sources import extract, languages
from ..sources.storage import table
from .catalogue import CATALOGUE, Query, query

# A file of each language, and what stands in it: (line, kind, name, target). @N@ is the number of the file.
SAMPLES = {
    'java': (
        'package a.b;\nimport java.util.List;\n// class No {}\npublic class Foo@N@ extends Base implements Bar, Baz<T> {\n    private int x = "class Q {";\n    public Foo@N@(int a) { this.x = helper(a); }\n    @Override\n    public static List<String> run@N@(String s) throws E {\n        if (s == null) { return other.go(s); }\n        return helper(s);\n    }\n    int helper(int a) { return a; }\n}\n',
        [(2, 'imports', '', 'java.util.List'), (4, 'class', 'Foo@N@', ''), (4, 'inherits', 'Foo@N@', 'Bar'), (4, 'inherits', 'Foo@N@', 'Base'), (4, 'inherits', 'Foo@N@', 'Baz'), (6, 'calls', 'Foo@N@', 'helper'), (6, 'method', 'Foo@N@', 'Foo@N@'), (8, 'method', 'run@N@', 'Foo@N@'), (9, 'calls', 'run@N@', 'other.go'), (10, 'calls', 'run@N@', 'helper'), (12, 'method', 'helper', 'Foo@N@')],
    ),
    'go': (
        'package main\nimport (\n\t"fmt"\n\t"os"\n)\ntype Server@N@ struct {\n\tx int\n}\nfunc (s *Server@N@) Run(a int) error {\n\tfmt.Println("x")\n\treturn helper@N@(a)\n}\nfunc helper@N@(a int) error { return nil }\n',
        [(3, 'imports', '', 'fmt'), (4, 'imports', '', 'os'), (6, 'class', 'Server@N@', ''), (9, 'method', 'Run', 'Server@N@'), (10, 'calls', 'Run', 'fmt.Println'), (11, 'calls', 'Run', 'helper@N@'), (13, 'function', 'helper@N@', '')],
    ),
    'javascript': (
        'import React, { useState } from \'react\';\nconst fs = require("fs");\nexport class App@N@ extends Component {\n  render() {\n    return build@N@(this.x);\n  }\n}\nexport function build@N@(a) {\n  if (a) { log(a); }\n}\nconst go = async (x) => { build@N@(x); };\n',
        [(1, 'imports', '', 'react'), (2, 'imports', '', 'fs'), (3, 'class', 'App@N@', ''), (3, 'inherits', 'App@N@', 'Component'), (4, 'method', 'render', 'App@N@'), (5, 'calls', 'render', 'build@N@'), (8, 'function', 'build@N@', ''), (9, 'calls', 'build@N@', 'log'), (11, 'calls', 'go', 'build@N@'), (11, 'function', 'go', '')],
    ),
    'rust': (
        'use std::io;\npub struct P@N@ { x: i32 }\ntrait T: Base + Other { fn m(&self); }\nimpl P@N@ {\n    pub fn new(x: i32) -> P@N@ { helper@N@(x) }\n}\nfn helper@N@(x: i32) -> P@N@ { P@N@ { x } }\n',
        [(1, 'imports', '', 'std::io'), (2, 'class', 'P@N@', ''), (3, 'class', 'T', ''), (3, 'inherits', 'T', 'Base'), (3, 'inherits', 'T', 'Other'), (4, 'class', 'P@N@', ''), (5, 'calls', 'new', 'helper@N@'), (5, 'method', 'new', 'P@N@'), (7, 'function', 'helper@N@', '')],
    ),
    'ruby': (
        "require 'set'\nclass A@N@ < B\n  def go@N@(x)\n    run(x)\n  end\nend\n",
        [(1, 'imports', '', 'set'), (2, 'class', 'A@N@', ''), (2, 'inherits', 'A@N@', 'B'), (3, 'method', 'go@N@', 'A@N@'), (4, 'calls', 'go@N@', 'run')],
    ),
    'c': (
        '#include <stdio.h>\nstruct S@N@ { int x; };\nstatic int run@N@(int a) {\n    printf("%d", a);\n    return helper(a);\n}\n',
        [(1, 'imports', '', 'stdio.h'), (2, 'class', 'S@N@', ''), (3, 'function', 'run@N@', ''), (4, 'calls', 'run@N@', 'printf'), (5, 'calls', 'run@N@', 'helper')],
    ),
    'kotlin': (
        'import a.b.C\nclass X@N@(val a: Int) : Y(), Z {\n    fun go@N@(s: String): Int {\n        return run(s)\n    }\n}\nfun run(s: String) = 1\n',
        [(1, 'imports', '', 'a.b.C'), (2, 'class', 'X@N@', ''), (2, 'inherits', 'X@N@', 'Y'), (2, 'inherits', 'X@N@', 'Z'), (3, 'method', 'go@N@', 'X@N@'), (4, 'calls', 'go@N@', 'run'), (7, 'function', 'run', '')],
    ),
    'swift': (
        'import UIKit\nclass V@N@: UIView, P {\n    func go@N@(_ x: Int) -> Int {\n        return run(x)\n    }\n}\n',
        [(1, 'imports', '', 'UIKit'), (2, 'class', 'V@N@', ''), (2, 'inherits', 'V@N@', 'P'), (2, 'inherits', 'V@N@', 'UIView'), (3, 'method', 'go@N@', 'V@N@'), (4, 'calls', 'go@N@', 'run')],
    ),
    'csharp': (
        'using System.Text;\nnamespace N {\n    public class A : B, IC@N@ {\n        public int Go@N@(int x) {\n            return Run(x);\n        }\n    }\n}\n',
        [(1, 'imports', '', 'System.Text'), (2, 'class', 'N', ''), (3, 'class', 'A', 'N'), (3, 'inherits', 'A', 'B'), (3, 'inherits', 'A', 'IC@N@'), (4, 'method', 'Go@N@', 'A'), (5, 'calls', 'Go@N@', 'Run')],
    ),
    'php': (
        '<?php\nuse App\\Models\\User;\nclass A@N@ extends B implements C {\n    public function go@N@($x) {\n        return run($x);\n    }\n}\n',
        [(2, 'imports', '', 'App\\Models\\User'), (3, 'class', 'A@N@', ''), (3, 'inherits', 'A@N@', 'B'), (3, 'inherits', 'A@N@', 'C'), (4, 'method', 'go@N@', 'A@N@'), (5, 'calls', 'go@N@', 'run')],
    ),
    'bash': (
        '#!/bin/bash\nsource lib.sh\nfunction go@N@() {\n  run_it@N@ a\n}\nrun_it@N@() {\n  echo x\n}\n',
        [(2, 'imports', '', 'lib.sh'), (3, 'function', 'go@N@', ''), (4, 'calls', 'go@N@', 'run_it@N@'), (6, 'function', 'run_it@N@', '')],
    ),
    'lua': (
        "local m = require('mod')\nfunction M@N@.go@N@(x)\n  return run(x)\nend\n",
        [(1, 'imports', '', 'mod'), (2, 'method', 'go@N@', 'M@N@'), (3, 'calls', 'go@N@', 'run')],
    ),
    'scala': (
        'import a.b.{C, D}\nclass X@N@ extends Y with Z {\n  def go@N@(x: Int): Int = {\n    run(x)\n  }\n}\n',
        [(1, 'imports', '', 'a.b.{C, D}'), (2, 'class', 'X@N@', ''), (2, 'inherits', 'X@N@', 'Y'), (2, 'inherits', 'X@N@', 'Z'), (3, 'method', 'go@N@', 'X@N@'), (4, 'calls', 'go@N@', 'run')],
    ),
    'elixir': (
        'defmodule A.B do\n  alias X@N@.Y\n  def go@N@(x) do\n    run(x)\n  end\nend\n',
        [(1, 'class', 'A.B', ''), (2, 'imports', '', 'X@N@.Y'), (3, 'method', 'go@N@', 'A.B'), (4, 'calls', 'go@N@', 'run')],
    ),
    'julia': (
        'using A, B\nstruct P@N@ <: Q\n  x\nend\nfunction go@N@(x)\n  run(x)\nend\n',
        [(1, 'imports', '', 'A'), (1, 'imports', '', 'B'), (2, 'class', 'P@N@', ''), (2, 'inherits', 'P@N@', 'Q'), (5, 'function', 'go@N@', ''), (6, 'calls', 'go@N@', 'run')],
    ),
    'fortran': (
        'module m@N@\n  use base\ncontains\n  subroutine go@N@(x)\n    call run(x)\n  end subroutine\nend module\n',
        [(1, 'class', 'm@N@', ''), (2, 'imports', '', 'base'), (4, 'method', 'go@N@', 'm@N@'), (5, 'calls', 'go@N@', 'run')],
    ),
    'dart': (
        "import 'a.dart';\nclass A@N@ extends B {\n  int go@N@(int x) {\n    return run(x);\n  }\n}\n",
        [(1, 'imports', '', 'a.dart'), (2, 'class', 'A@N@', ''), (2, 'inherits', 'A@N@', 'B'), (3, 'method', 'go@N@', 'A@N@'), (4, 'calls', 'go@N@', 'run')],
    ),
    'zig': (
        'const std = @import("std");\nconst P@N@ = struct {\n    x: i32,\n};\npub fn go@N@(x: i32) i32 {\n    return run(x);\n}\n',
        [(1, 'imports', '', 'std'), (2, 'class', 'P@N@', ''), (5, 'function', 'go@N@', ''), (6, 'calls', 'go@N@', 'run')],
    ),
    'powershell': (
        'Import-Module Foo@N@\nfunction Get-Thing {\n    Write-Out@N@ $x\n}\n',
        [(1, 'imports', '', 'Foo@N@'), (2, 'function', 'Get-Thing', ''), (3, 'calls', 'Get-Thing', 'Write-Out@N@')],
    ),
    'objectivec': (
        '#import <A/B.h>\n@interface V@N@ : Base\n- (void)go@N@:(int)x;\n@end\n',
        [(1, 'imports', '', 'A/B.h'), (2, 'class', 'V@N@', ''), (2, 'inherits', 'V@N@', 'Base'), (3, 'function', 'go@N@', '')],
    ),
    'verilog': (
        '`include "a.v"\nmodule top@N@(input a);\n  function int go@N@(int x);\n    return run(x);\n  endfunction\nendmodule\n',
        [(1, 'imports', '', 'a.v'), (2, 'class', 'top@N@', ''), (3, 'method', 'go@N@', 'top@N@'), (4, 'calls', 'go@N@', 'run')],
    ),
    'pascal': (
        'unit U;\nuses A, B;\ntype\n  T@N@ = class(Base)\n    procedure Go@N@(x: Integer);\n  end;\n',
        [(1, 'class', 'U', ''), (2, 'imports', '', 'A'), (2, 'imports', '', 'B'), (4, 'class', 'T@N@', 'U'), (5, 'method', 'Go@N@', 'T@N@')],
    ),
    'groovy': (
        'import a.B\nclass A@N@ extends B {\n    def go@N@(x) {\n        run(x)\n    }\n}\n',
        [(1, 'imports', '', 'a.B'), (2, 'class', 'A@N@', ''), (2, 'inherits', 'A@N@', 'B'), (3, 'method', 'go@N@', 'A@N@'), (4, 'calls', 'go@N@', 'run')],
    ),
    'apex': (
        'public class A@N@ extends B {\n    public Integer go@N@(Integer x) {\n        return run(x);\n    }\n}\n',
        [(1, 'class', 'A@N@', ''), (1, 'inherits', 'A@N@', 'B'), (2, 'method', 'go@N@', 'A@N@'), (3, 'calls', 'go@N@', 'run')],
    ),
    'terraform': (
        'resource "aws_x@N@" "y@N@" {\n  source = "./m"\n}\n',
        [(1, 'class', 'aws_x@N@', ''), (2, 'imports', '', './m')],
    ),
}

def _files(spark, d, language: str):
    n = F.col("n_nationkey").cast("string")
    text = F.replace(F.lit(SAMPLES[language][0]), F.lit("@N@"), n)
    return table(spark, d, "nation").select(F.concat(F.lit("src/f"), n, F.lit("." + languages.LANGUAGES[language].endings[0])).alias("path"), text.alias("text"))


def _quoted(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _facts_sql(language: str) -> str:
    rows = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in SAMPLES[language][1])
    return f"""SELECT 'src/f' || n_nationkey || '.{languages.LANGUAGES[language].endings[0]}' AS path, line::BIGINT AS line, kind, replace(name, '@N@', n_nationkey::VARCHAR) AS name, replace(target, '@N@', n_nationkey::VARCHAR) AS target
FROM nation, (VALUES {rows}) AS t(line, kind, name, target)"""


def _facts_query(language: str):
    return lambda spark, d: languages.extract(_files(spark, d, language))


for _language in SAMPLES:
    CATALOGUE[f"facts_{_language}"] = Query(_facts_query(_language), _facts_sql(_language))

_PYTHON = "import os\nfrom a.b import c\n\nclass K@N@(Base):\n    def go(self):\n        return run@N@(self)\n\ndef run@N@(x):\n    return x.y()\n"


@query(
    """SELECT 'src/f' || n_nationkey || '.py' AS path, kind, replace(name, '@N@', n_nationkey::VARCHAR) AS name, replace(target, '@N@', n_nationkey::VARCHAR) AS target FROM nation, (VALUES
('imports', '', 'os'), ('imports_from', '', 'a.b.c'), ('class', 'K@N@', ''), ('inherits', 'K@N@', 'Base'), ('method', 'go', 'K@N@'), ('calls', 'K@N@.go', 'run@N@'), ('function', 'run@N@', ''), ('calls', 'run@N@', 'x.y')) AS t(kind, name, target)"""
)
def facts_python(spark, d):
    n = F.col("n_nationkey").cast("string")
    return extract.extract_python(table(spark, d, "nation").select(F.concat(F.lit("src/f"), n, F.lit(".py")).alias("path"), F.replace(F.lit(_PYTHON), F.lit("@N@"), n).alias("text")))


@query(
    """WITH n AS (SELECT n_nationkey::VARCHAR AS n FROM nation) SELECT 'src_f' || n AS id, 'f' || n || '.rb' AS label, 1::BIGINT AS line FROM n UNION ALL SELECT 'src_f' || n || '_a' || n, 'A' || n, 2 FROM n UNION ALL SELECT 'src_f' || n || '_a' || n || '_go' || n, '.go' || n || '()', 3 FROM n"""
)
def source_graph_nodes(spark, d):
    return languages.to_graph(languages.extract(_files(spark, d, "ruby")))[0].select("id", "label", "line")


@query(
    """WITH n AS (SELECT n_nationkey::VARCHAR AS n FROM nation), f AS (SELECT 'src_f' || n AS f, n FROM n) SELECT f AS src, f || '_server' || n AS dst, 'contains' AS relation FROM f UNION ALL SELECT f, f || '_helper' || n, 'contains' FROM f
UNION ALL SELECT f || '_server' || n, f || '_server' || n || '_run', 'method' FROM f UNION ALL SELECT f, 'fmt', 'imports' FROM f UNION ALL SELECT f, 'os', 'imports' FROM f UNION ALL SELECT f || '_server' || n || '_run', f || '_helper' || n, 'calls' FROM f"""
)
def source_graph_edges(spark, d):
    return languages.to_graph(languages.extract(_files(spark, d, "go")))[1].select("src", "dst", "relation")


# ---- resolution ----


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, 'n' || (l_partkey % 40) AS callee, 'f' || (l_suppkey % 30) AS f FROM lineitem), i AS (SELECT DISTINCT 'f' || (s_suppkey % 30) AS f, 'm' || (s_suppkey % 8) AS m, 'n' || (s_suppkey % 40) AS n FROM supplier),
d AS (SELECT 'm' || (p_partkey % 8) AS m, 'n' || (p_partkey % 55) AS n, 'p' || p_partkey AS id FROM part WHERE p_size < 8), o AS (SELECT m, n, min(id) AS id FROM d GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), k AS (SELECT f, n, min(id) AS id FROM i JOIN o USING (m, n) GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT call_id, id FROM c JOIN k ON k.f = c.f AND k.n = c.callee"""
)
def import_guided_calls(spark, d):
    num = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    li, s, p = table(spark, d, "lineitem"), F.col("s_suppkey"), F.col("p_partkey")
    c = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), num("n", F.col("l_partkey") % 40).alias("callee"), num("f", F.col("l_suppkey") % 30).alias("source_file"))
    i = table(spark, d, "supplier").select(num("f", s % 30).alias("source_file"), num("m", s % 8).alias("module"), num("n", s % 40).alias("name"), F.lit(None).cast("string").alias("alias"))
    return resolution.resolve_imported(c, i, table(spark, d, "part").filter("p_size < 8").select(num("m", p % 8).alias("module"), num("n", p % 55).alias("name"), num("p", p).alias("id")))


@query(
    """WITH RECURSIVE k AS (SELECT DISTINCT p_size AS s FROM part), x AS (SELECT 'm' || s AS m, 'n' AS n, 'm' || (s // 2) AS fm, 'n' AS fn FROM k WHERE s > 1), w AS (SELECT m, n, fm, fn, 1 AS r FROM x WHERE m <> 'm3' UNION ALL SELECT w.m, w.n, x.fm, x.fn, r + 1 FROM w JOIN x ON x.m = w.fm AND x.n = w.fn WHERE r < 8 AND w.fm <> 'm3')
SELECT 'm1' AS module, 'n' AS name, 'root' AS id UNION ALL SELECT 'm3', 'n', 'three' UNION ALL SELECT m, n, CASE fm WHEN 'm1' THEN 'root' ELSE 'three' END FROM w WHERE fm IN ('m1', 'm3')"""
)
def export_chains(spark, d):
    k = table(spark, d, "part").select("p_size").distinct()
    m = lambda c: F.concat(F.lit("m"), c.cast("string"))
    x = k.filter("p_size > 1").select(m(F.col("p_size")).alias("module"), F.lit("n").alias("name"), m(F.floor(F.col("p_size") / 2)).alias("from_module"), F.lit("n").alias("from_name"))
    return resolution.follow_exports(x, spark.createDataFrame([("m1", "n", "root"), ("m3", "n", "three")], "module string, name string, id string"))


def _index(spark, d):
    """An index of documents: parts are symbols, some of one name in several documents; they relate to others, some unknown."""
    p = F.col("p_partkey")
    num = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    name = F.when(p % 5 == 0, F.lit("Common")).otherwise(num("Sym", p))
    to = F.when(p % 3 == 0, F.lit("Common")).when(p % 3 == 1, num("Sym", p + 1)).otherwise(num("Gone ", p % 4))
    rel = F.array(F.struct(to.alias("symbol"), (p % 2 == 0).alias("is_implementation"), F.lit(False).alias("is_reference"), F.lit(False).alias("is_type_definition")))
    s = F.struct(name.alias("symbol"), rel.alias("relationships"), F.array(F.struct(F.array((p % 100).cast("int"), F.lit(0)).alias("range"))).alias("occurrences"))
    return table(spark, d, "part").groupBy(num("d", p % 20).alias("relative_path")).agg(F.collect_list(s).alias("symbols"))


INDEX = """s AS (SELECT 'd' || (p_partkey % 20) AS document, CASE WHEN p_partkey % 5 = 0 THEN 'Common' ELSE 'Sym' || p_partkey END AS symbol, p_partkey AS k FROM part), ids AS (SELECT *, document || '_' || lower(symbol) AS id FROM s),
r AS (SELECT document, id AS src, CASE WHEN k % 3 = 0 THEN 'Common' WHEN k % 3 = 1 THEN 'Sym' || (k + 1) ELSE 'Gone ' || (k % 4) END AS symbol, CASE WHEN k % 2 = 0 THEN 'implements' ELSE 'references' END AS relation FROM ids),
only_ AS (SELECT symbol, min(id) AS id FROM ids GROUP BY 1 HAVING count(DISTINCT id) = 1),
e AS (SELECT src, coalesce((SELECT min(id) FROM ids WHERE ids.document = r.document AND ids.symbol = r.symbol), (SELECT id FROM only_ WHERE only_.symbol = r.symbol)) AS dst, symbol, relation FROM r)"""


@query(f"WITH {INDEX} SELECT DISTINCT src, coalesce(dst, 'external_' || replace(lower(symbol), ' ', '_')) AS dst, relation FROM e")
def index_relations(spark, d):
    symbols, relations = resolution.scip_rows(_index(spark, d))
    return resolution.resolve_symbols(relations, symbols)[0]


@query(f"WITH {INDEX} SELECT DISTINCT 'external_' || replace(lower(symbol), ' ', '_') AS id, symbol AS label FROM e WHERE dst IS NULL")
def index_stubs(spark, d):
    symbols, relations = resolution.scip_rows(_index(spark, d))
    return resolution.resolve_symbols(relations, symbols)[1]


@query(f"WITH {INDEX} SELECT document, symbol, id, (k % 100 + 1)::BIGINT AS line FROM ids")
def index_symbols(spark, d):
    return resolution.scip_rows(_index(spark, d))[0]
