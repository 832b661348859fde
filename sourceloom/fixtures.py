"""Derived input tables: SELECT texts that Spark and the oracle engine both read.

The given tables hold no source code, so a corpus is derived from them: ids become
paths, repositories and file contents. The texts below stay in the SQL subset that both
engines share. ``source_files`` is templated, hence its selectivity is artificial.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _template(text: str) -> str:
    """A concat expression for a template: ``{k}`` and ``{lib}`` stand for columns."""
    parts: list[str] = []
    for line in text.strip("\n").split("\n"):
        rest = line
        while rest:
            cut = min((rest.find(p), p) for p in ("{k}", "{lib}") if p in rest) if ("{k}" in rest or "{lib}" in rest) else None
            literal = rest if cut is None else rest[: cut[0]]
            if literal:
                parts.append("'" + literal.replace("'", "''") + "'")
            if cut is None:
                break
            parts.append(cut[1].strip("{}"))
            rest = rest[cut[0] + len(cut[1]) :]
        parts.append("chr(10)")
    return "concat(" + ", ".join(parts) + ")"


_PY = _template("""
import os
import {lib}
from typing import List, Optional
MAX_RETRIES = {k}
class Svc{k}(Base):
    "Service {k}."
    def get(self, key: str):
        return key
def run_{k}(x, y: int):
    "Run {k}."
    return x
""")

_PY_MORE = _template('''
from enum import Enum
from os.path import (
    join,
    split as cut,
)
import json as js
class Level{k}(Enum):
    """Levels."""
    LOW = 1
    HIGH = "h{k}"
class Repo{k}(Base, mixins.Mixin):
    """
    Store of {lib}.

    Keeps rows.
    """
    size: int = {k}
    tag = "t"
    def __init__(self, name: str, *args, limit=3, **kw):
        self.name = name
    async def load(self, keys: Dict[str, int] = None):
        """Load keys."""
        return keys
    @property
    def hidden(self):
        return 1
@cached
def decorated_{k}(x):
    return x
timeout_{k}: float = 1.5
label = "run {k}"
pair, other = 1, 2
''')

_JS = _template("""
import Lib from '{lib}';
import { a, b } from './utils';
const LIMIT = {k};
class Svc{k} extends Base {
  get(key) { return key; }
}
function run_{k}(x, y) {
  return x;
}
""")

_JS_MORE = _template("""
import * as tools from "./tools";
import { default as Main, helper as aid } from 'pkg{k}';
/**
 * Store {k}.
 * @class
 */
class Store{k} {
  static count = 0;
  size = {k};
  /** Make it. */
  constructor(name, limit = 3, ...rest) {
    this.name = name;
  }
  async load(keys) {
    if (keys) {
      return keys;
    }
  }
}
/** Adds up. */
function add_{k}(a, b = 1, ...rest) {
  const inner = a;
  return a;
}
handler = (evt, ctx) => { return evt; };
let state = null;
var label = "l{k}";
export const VERSION = '{k}';
export function helper(x) {
  return x;
}
export { run_{k} as run, aid };
export default Store{k};
""")

_CPP = _template("""
#include <vector>
#include "{lib}.h"
const int LIMIT = {k};
class Svc{k} : public Base {
};
int run_{k}(int x, int y) {
  return x;
}
enum Color { RED, GREEN = {k} };
""")

_CPP_MORE = _template("""
/**
 * Point of {k}.
 */
struct Point{k} : Base, protected Other {
  int x;
  double y = 0.5;
  Point{k}(int a, int b) : x(a), y(b) {}
  // Sums up.
  // Twice.
  int sum(const std::vector<int>& data, int* out) const {
    return x;
  }
  void reset();
};
// Scales.
double scale_{k}(double v, double f = 2.0) {
  return v * f;
}
void declared_{k}(int n, ...);
static int counter = 0;
extern int shared;
int table[10];
enum class Mode : int { OFF = 0, ON = {k}, AUTO };
namespace ns{k} {
class Inner{k} {
  int z;
};
}
""")

_JL = _template("""
using {lib}
import Base: show
const LIMIT = {k}
struct Svc{k} <: Base
  x::Int
end
function run_{k}(x, y::Int)
  return x
end
""")

_JL_MORE = _template("""
using Stats: mean, std
"Area of {k}."
function area_{k}(w::Float64, h; scale=1, mode::Int=2)
  function inner_{k}(q)
    return q
  end
  step(r) = r + 1
  return w * h
end
square(x) = x^2
macro twice(ex)
  quote
    run(ex)
  end
end
mutable struct Box{k} <: Shape
  w::Float64
  items::Vector{Int}
  Box{k}(r) = new(r)
end
const NAME = "n{k}"
ratio = 0.5
Grid = Matrix{Float64}
module Mod{k}
import Deep.Core
function held(x)
  return x
end
const INSIDE = 4
end
""")

# Endings that break a file: open brackets, a block without end, an open parameter list.
_BREAK = _template("""
def broken_{k}(
    x
""")
_BREAK_END = _template("""
function open_{k}(x)
  return x
""")
_BREAK_PAREN = _template("""
function open_{k}(x
  return x
""")

# Base content per language; two of three files get the second part, some are broken.
SOURCE_FILES = f"""
SELECT doc_id AS file_id, repo, concat(dir, '/', stem, ext) AS path,
 CASE ext
 WHEN '.py' THEN concat({_PY}, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_PY_MORE} END, CASE WHEN doc_id % 41 = 0 THEN {_BREAK} ELSE '' END)
 WHEN '.js' THEN concat({_JS}, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_JS_MORE} END, CASE WHEN doc_id % 41 = 0 THEN {_BREAK} ELSE '' END)
 WHEN '.cpp' THEN concat({_CPP}, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_CPP_MORE} END, CASE WHEN doc_id % 41 = 0 THEN {_BREAK} ELSE '' END)
 WHEN '.jl' THEN concat({_JL}, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_JL_MORE} END, CASE WHEN doc_id % 13 = 0 THEN {_BREAK_END} WHEN doc_id % 17 = 0 THEN {_BREAK_PAREN} ELSE '' END)
 ELSE text END AS content,
 lang, n_chars
FROM (SELECT doc_id, text, lang, n_chars, concat('repo_src', CAST(doc_id % 20 AS STRING)) AS repo, CAST(doc_id % 97 AS STRING) AS k,
  CASE doc_id % 12 WHEN 0 THEN 'src/app' WHEN 1 THEN 'src/utils' WHEN 2 THEN 'tests/unit' WHEN 3 THEN 'config' WHEN 4 THEN 'app/models' WHEN 5 THEN 'app/controllers'
   WHEN 6 THEN 'svc/service' WHEN 7 THEN 'ui/component' WHEN 8 THEN 'node_modules/pkg' WHEN 9 THEN 'build/out' WHEN 10 THEN 'docs' ELSE 'core' END AS dir,
  CASE WHEN doc_id % 23 = 0 THEN 'main' WHEN doc_id % 29 = 0 THEN '__init__' WHEN (doc_id % 300) % 13 = 0 THEN concat('g_', CAST(doc_id % 300 AS STRING)) ELSE concat('f_', CAST(doc_id AS STRING)) END AS stem,
  CASE (doc_id + CAST((doc_id - doc_id % 300) / 300 AS BIGINT)) % 10 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.py' WHEN 3 THEN '.py' WHEN 4 THEN '.js' WHEN 5 THEN '.js' WHEN 6 THEN '.cpp' WHEN 7 THEN '.jl' WHEN 8 THEN '.md' ELSE '.log' END AS ext,
  CASE doc_id % 7 WHEN 0 THEN 'flask' WHEN 1 THEN 'pytest' WHEN 2 THEN 'sqlalchemy' WHEN 3 THEN 'numpy' WHEN 4 THEN 'torch' ELSE 'mylocal' END AS lib
 FROM documents) t
"""

IGNORE_PATTERNS = """
SELECT * FROM (VALUES (1, '# build products'), (2, 'build/'), (3, ''), (4, '*.log'), (5, 'temp*'), (6, '  docs/  '), (7, 'src/app/f_1*'), (8, 'f_[!1-8]?.md')) AS t(line_no, line)
"""

# Page addresses as a second set of paths: host as repository, path without query.
PAGE_PATHS = """
SELECT page_id AS file_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
 regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path
FROM pages
"""

COMMITS = """
SELECT o_orderkey AS commit_id, concat('repo_src', CAST(o_custkey % 20 AS STRING)) AS repo, o_custkey AS author_id, o_orderdate AS commit_ts
FROM orders
"""

CHANGES = """
SELECT commit_id, file_id, min(seq) AS seq
FROM (SELECT l_orderkey AS commit_id, CASE WHEN l_partkey % 11 = 0 THEN -1 - l_partkey ELSE l_partkey END AS file_id, l_linenumber AS seq FROM lineitem) c
GROUP BY commit_id, file_id
"""

# One marker per repository: NULL = never built, -1 = unknown commit, else g commits
# behind the newest one. The rank filter lets both engines keep ten rows per repository.
KB_SNAPSHOTS = """
SELECT repo, CASE WHEN g = 9 THEN NULL WHEN g = 8 THEN CAST(-1 AS BIGINT) ELSE commit_id END AS stored_commit
FROM (SELECT repo, commit_id, CAST(substr(repo, 9) AS BIGINT) % 10 AS g, row_number() OVER (PARTITION BY repo ORDER BY commit_ts DESC, commit_id DESC) AS back
 FROM (SELECT o_orderkey AS commit_id, concat('repo_src', CAST(o_custkey % 20 AS STRING)) AS repo, o_orderdate AS commit_ts FROM orders) c) s
WHERE back <= 10 AND back = g + 1
"""

COMPLETIONS = """
SELECT conv_id, turn,
 CASE (conv_id + turn) % 6
 WHEN 0 THEN concat(text, chr(10), 'Sure. ```json', chr(10), j, chr(10), '``` done') WHEN 1 THEN j WHEN 2 THEN concat(text, ' Here is it: ', j, ' hope it helps')
 WHEN 3 THEN concat('no json ', text) WHEN 4 THEN concat(text, '{"type": "', ty, '", "desc') ELSE concat('```', j, '```') END AS completion
FROM (SELECT conv_id, turn, text, ty, concat('{"type": "', ty, '", "scope": ', CASE WHEN turn % 3 = 0 THEN 'null' ELSE '"core"' END,
   ', "description": "', CASE WHEN conv_id % 11 = 0 THEN '  ' ELSE concat('change ', CAST(conv_id AS STRING)) END, '", "body": ', CASE WHEN turn % 2 = 0 THEN 'null' ELSE concat('" ', translate(text, concat('"', chr(92), chr(10), chr(13), chr(9)), '     '), ' "') END, '}') AS j
  FROM (SELECT conv_id, turn, text, CASE conv_id % 9 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'docs' WHEN 3 THEN 'style' WHEN 4 THEN 'refactor' WHEN 5 THEN 'test' WHEN 6 THEN 'chore' ELSE 'perf' END AS ty
   FROM conversations WHERE role = 'assistant') a) b
"""

# Answers of a second try: to some of the failed ones, to some that need none, some invalid again, some delivered twice.
RETRY_ANSWERS = """
SELECT conv_id, turn, CAST(1 AS BIGINT) AS attempt,
 CASE WHEN conv_id % 4 = 1 THEN concat(text, chr(10), '{"type": 3, "description": "again"}')
 ELSE concat(text, chr(10), '```json', chr(10), '{"type": "', CASE WHEN conv_id % 3 = 0 THEN 'docs' ELSE 'retry' END, '", "scope": null, "description": "again ', CAST(turn AS STRING), '", "body": null}', chr(10), '```') END AS completion
FROM (SELECT conv_id, turn, text, role FROM conversations UNION ALL SELECT conv_id, turn, text, role FROM conversations WHERE conv_id % 7 = 0) c
WHERE role = 'assistant' AND (conv_id + turn) % 6 IN (1, 3, 4) AND conv_id % 4 <> 0
"""

GEN_PARAMS = """
SELECT event_id, value / 50.0 AS temperature, 1.2 - value / 100.0 AS top_p, CAST(event_id % 4 AS INT) - 1 AS num_return_sequences
FROM events
"""

TRAILERS = """
SELECT o_orderkey AS commit_id,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('#', CAST(o_custkey AS STRING)) ELSE '' END AS issue_refs,
 CASE WHEN o_orderstatus = 'P' THEN concat('drops ', o_orderpriority) ELSE '' END AS breaking_desc
FROM orders
"""

DIFFS = """
SELECT o_orderkey AS commit_id, CASE WHEN o_orderkey % 5 = 0 THEN concat('  ', chr(10)) ELSE concat('diff --git a/f b/f', chr(10), '+', o_orderpriority) END AS diff
FROM orders
"""

RAW_CHANGES = """
SELECT doc_id AS commit_id, concat(source, '/a.py', chr(10), '   ', chr(10), ' ', lang, '/b.py ', chr(10), chr(10), CASE WHEN doc_id % 3 = 0 THEN '/c.js' ELSE '' END) AS stdout
FROM documents
"""

DERIVED = {
    "source_files": SOURCE_FILES,
    "ignore_patterns": IGNORE_PATTERNS,
    "page_paths": PAGE_PATHS,
    "commits": COMMITS,
    "changes": CHANGES,
    "kb_snapshots": KB_SNAPSHOTS,
    "completions": COMPLETIONS,
    "retry_answers": RETRY_ANSWERS,
    "gen_params": GEN_PARAMS,
    "trailers": TRAILERS,
    "diffs": DIFFS,
    "raw_changes": RAW_CHANGES,
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    # The plan is resolved right away, so a later call for another folder does not change it.
    for table in TABLES:
        if re.search(rf"FROM {table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)
