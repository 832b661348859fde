"""SQL twins of the catalog queries.

They are written independently of the Spark jobs: where the jobs cut text by bracket
groups, the twins walk numbered lines with running sums and windows. They hold for the
derived corpus of ``fixtures``; patterns stay in the subset the oracle engine supports.
"""

from __future__ import annotations

from sourceloom.fixtures import DERIVED

ORACLES: dict[str, str] = {}

_VIEWS: dict[str, str] = dict(DERIVED)
_TEXTS: dict[str, str] = {}


def view(name: str, text: str) -> None:
    _VIEWS[name] = text


def _needs(text: str) -> list[str]:
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return [v for v in _VIEWS if v in words]


def _closure(text: str) -> list[str]:
    """Views a text needs, each after the ones it builds on."""
    ordered: list[str] = []

    def visit(v: str) -> None:
        if v not in ordered:
            for inner in _needs(_VIEWS[v]):
                if inner != v:
                    visit(inner)
            ordered.append(v)

    for v in _needs(text):
        visit(v)
    return ordered


def oracle(name: str, text: str) -> None:
    _TEXTS[name] = text.strip()


# --- shared views ------------------------------------------------------------------

view("all_paths", "SELECT file_id, repo, path FROM source_files UNION ALL SELECT file_id, repo, path FROM page_paths")
view(
    "named",
    r"""SELECT file_id, repo, path, content, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS ext,
 regexp_extract(path, '([^/]*)$', 1) AS name FROM source_files""",
)
view(
    "code",
    """SELECT *, CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript'
 WHEN ext IN ('.cpp', '.cc', '.cxx', '.hpp', '.hxx') THEN 'cpp' WHEN ext = '.jl' THEN 'julia' END AS language FROM named""",
)
view(
    "health",
    r"""SELECT file_id, CASE WHEN language IS NULL THEN 'none'
 WHEN length(content) - length(replace(content, '(', '')) <> length(content) - length(replace(content, ')', ''))
  THEN CASE WHEN language = 'julia' AND NOT regexp_matches(content, 'function\s+\w+\s*\([^)]*$') THEN 'recovered' ELSE 'failed' END
 WHEN language = 'julia' AND len(regexp_extract_all(content, '(?m)^\s*(?:mutable )?(?:function|struct|macro|quote|module|if|for|while|begin)\b'))
   <> len(regexp_extract_all(content, '(?m)^\s*end\b')) THEN 'recovered'
 ELSE 'ok' END AS state FROM code""",
)
view(
    "text_lines",
    """SELECT file_id, language, state, unnest(string_split(content, chr(10))) AS line,
 generate_subscripts(string_split(content, chr(10)), 1) AS line_no
 FROM code JOIN health USING (file_id) WHERE language IS NOT NULL""",
)
view(
    "py_lines",
    r"""SELECT *, last_value(CASE WHEN regexp_matches(line, '^[A-Za-z@]') THEN line END IGNORE NULLS)
  OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top,
 lag(line) OVER (PARTITION BY file_id ORDER BY line_no) AS before, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS after
 FROM text_lines WHERE language = 'python' AND state = 'ok'""",
)
view(
    "py_defs",
    r"""SELECT file_id, line_no, line, after, CASE WHEN line LIKE ' %' THEN regexp_extract(top, '^class (\w+)', 1) END AS owner,
 regexp_extract(line, 'def (\w+)', 1) AS name, regexp_extract(line, 'def \w+\((.*)\)', 1) AS params
 FROM py_lines WHERE regexp_matches(line, '^(    )?(async )?def ') AND NOT coalesce(ltrim(before) LIKE '@%', false)
 AND (line NOT LIKE ' %' OR top LIKE 'class %')""",
)
view(
    "brace_lines",
    """SELECT *, last_value(CASE WHEN level = 0 THEN line END IGNORE NULLS)
  OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top
 FROM (SELECT *, depth - CASE WHEN in_ns THEN 1 ELSE 0 END AS level FROM (
  SELECT *, depth > 0 AND last_value(CASE WHEN depth = 0 THEN line LIKE 'namespace %' END IGNORE NULLS)
   OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_ns FROM (
  SELECT *, coalesce(sum(length(line) - length(replace(line, '{', '')) - length(line) + length(replace(line, '}', '')))
   OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
  FROM text_lines WHERE language IN ('javascript', 'cpp') AND state = 'ok')))""",
)
view("js_lines", "SELECT * FROM brace_lines WHERE language = 'javascript'")
view("cpp_lines", "SELECT * FROM brace_lines WHERE language = 'cpp'")
view(
    "jl_lines",
    r"""SELECT *, CASE WHEN in_module THEN depth - 1 ELSE depth END AS level FROM (
 SELECT *, depth > 0 AND block LIKE 'module %' AS in_module FROM (
 SELECT *, last_value(CASE WHEN depth = 0 THEN line END IGNORE NULLS)
   OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block,
  lag(line) OVER (PARTITION BY file_id ORDER BY line_no) AS before FROM (
 SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '^\s*(?:mutable )?(?:function|struct|macro|quote|module|if|for|while|begin)\b') THEN 1
   WHEN regexp_matches(line, '^\s*end\b') THEN -1 ELSE 0 END)
   OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
 FROM text_lines WHERE language = 'julia' AND state = 'ok')))""",
)
view("jl_saved", "SELECT file_id, content FROM code JOIN health USING (file_id) WHERE state = 'recovered'")
view(
    "jl_fallback",
    r"""SELECT file_id, 'import' AS kind, unnest(regexp_extract_all(content, '(?m)^\s*(?:using|import)\s+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)', 1)) AS name FROM code WHERE language = 'julia'
 UNION ALL SELECT file_id, 'function', unnest(regexp_extract_all(content, '(?m)^\s*function\s+([A-Za-z_][A-Za-z0-9_!]*)\s*\(', 1)) FROM code WHERE language = 'julia'
 UNION ALL SELECT file_id, 'function', unnest(regexp_extract_all(content, '(?m)^\s*([A-Za-z_][A-Za-z0-9_!]*)\s*\([^)]*\)\s*=', 1)) FROM code WHERE language = 'julia'
 UNION ALL SELECT file_id, 'struct', unnest(regexp_extract_all(content, '(?m)^\s*(?:mutable\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM code WHERE language = 'julia'
 UNION ALL SELECT file_id, 'constant', unnest(regexp_extract_all(content, '(?m)^\s*const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=', 1)) FROM code WHERE language = 'julia'
 UNION ALL SELECT file_id, 'macro', concat('@', unnest(regexp_extract_all(content, '(?m)^\s*macro\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1))) FROM code WHERE language = 'julia'""",
)

# --- sources and filters -----------------------------------------------------------

view(
    "tree",
    r"""SELECT repo, concat('d', CAST(file_id AS STRING), '/', path) AS path, content FROM source_files
 UNION ALL SELECT repo, concat('d', CAST(file_id AS STRING), '/', regexp_extract(path, '^(.*)/[^/]*$', 1), '/.', regexp_extract(path, '([^/]*)$', 1)), content FROM source_files WHERE file_id % 5 = 0""",
)
_EXCLUDED = r"(?:^|/)(?:\.git|\.hg|\.svn|\.vscode|node_modules|__pycache__|\.sourceloom)/"
_SUPPORTED = r"(?i)\.(?:py|js|jsx|mjs|cjs|cpp|cc|cxx|hpp|hxx|jl)$"
oracle(
    "corpus_walk",
    f"""SELECT repo, path, length(content) AS n_chars, '' AS reason FROM tree
 WHERE NOT regexp_matches(path, '{_EXCLUDED}') AND regexp_matches(path, '{_SUPPORTED}')""",
)
oracle(
    "corpus_list",
    f"""SELECT repo, path, CASE WHEN regexp_matches(path, '{_SUPPORTED}') THEN '' ELSE 'unsupported' END AS status FROM tree WHERE NOT regexp_matches(path, '{_EXCLUDED}')
 UNION ALL SELECT DISTINCT repo, regexp_extract(path, '^(.*?{_EXCLUDED})', 1), 'ignored' FROM tree WHERE regexp_matches(path, '{_EXCLUDED}')""",
)
oracle("corpus_scan", "SELECT file_id, repo, path, length(content) AS n_chars FROM source_files")
view(
    "patterns",
    "SELECT CAST(line_no AS BIGINT) AS line_no, trim(line) AS pattern FROM ignore_patterns WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'",
)
oracle("ignore_load", "SELECT line_no, pattern FROM patterns")
view(
    "path_parts",
    """SELECT file_id, repo, path, string_split(path, '/') AS parts FROM all_paths""",
)
view(
    "path_tests",
    """SELECT file_id, repo, path, array_to_string(parts[1:i], '/') AS above, parts[i] AS part
 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM path_parts)""",
)
view(
    "ignored_paths",
    """SELECT DISTINCT t.file_id, t.repo, t.path FROM path_tests t JOIN patterns p
 ON t.above GLOB p.pattern OR t.part GLOB rtrim(p.pattern, '/')""",
)
view("default_out", "SELECT file_id, repo, path FROM path_parts WHERE list_has_any(parts[1:len(parts) - 1], ['.git', '.hg', '.svn', '.vscode', 'node_modules', '__pycache__', '.sourceloom'])")
oracle("default_ignore", "SELECT file_id, repo, path FROM default_out")
oracle(
    "ignore_match",
    "SELECT a.file_id, a.repo, a.path, i.file_id IS NOT NULL AS ignored FROM all_paths a LEFT JOIN ignored_paths i USING (file_id, repo, path)",
)
oracle("ignore_filter", "SELECT a.file_id, a.repo, a.path FROM all_paths a ANTI JOIN ignored_paths i USING (file_id, repo, path)")
view(
    "suffixes",
    r"""SELECT *, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS ext, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM all_paths""",
)
oracle(
    "language_map",
    """SELECT file_id, repo, path, CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript'
 WHEN ext IN ('.cpp', '.cc', '.cxx', '.hpp', '.hxx') THEN 'cpp' WHEN ext = '.jl' THEN 'julia' END AS language FROM suffixes""",
)
_SUPPORTED = " OR ".join(
    f"name LIKE '%{e}'" for e in (".py .js .jsx .mjs .cjs .cpp .cc .cxx .hpp .hxx .jl").split()
)
_QUIET = " OR ".join(
    f"name LIKE '%{e}'" for e in (".pyc .pyo .pyd .so .dll .exe .json .md .txt .log .gz .zip .tar").split()
)
oracle("supported_files", f"SELECT file_id, repo, path FROM suffixes WHERE {_SUPPORTED}")
oracle(
    "unsupported_files",
    f"SELECT file_id, repo, path FROM suffixes WHERE NOT ({_SUPPORTED}) AND NOT ({_QUIET}) AND name NOT LIKE '.%'",
)
view(
    "listed",
    """SELECT commit_id, i - 1 AS seq, trim(parts[i]) AS path FROM (SELECT commit_id, string_split(stdout, chr(10)) AS parts,
 unnest(range(1, len(string_split(stdout, chr(10))) + 1)) AS i FROM raw_changes)""",
)
oracle("change_paths", "SELECT commit_id, seq, path FROM listed WHERE path <> ''")
oracle("change_count", "SELECT commit_id, count(*) AS n_changed FROM listed WHERE path <> '' GROUP BY commit_id")
oracle(
    "diff_nonempty",
    r"""SELECT commit_id, CASE WHEN regexp_matches(diff, '\S') THEN diff END AS diff,
 CASE WHEN NOT regexp_matches(diff, '\S') THEN 'no staged changes' END AS reason FROM diffs""",
)
oracle(
    "snapshot_head",
    "SELECT repo, arg_max(commit_id, (commit_ts, commit_id)) AS head_commit, count(*) AS n_commits FROM commits GROUP BY repo",
)

# --- Python ------------------------------------------------------------------------

view(
    "py_import_rows",
    r"""SELECT file_id, CASE WHEN item LIKE '% as %' THEN regexp_extract(item, ' as (\w+)$', 1) ELSE item END AS name,
 regexp_extract(item, '^([\w.]+)', 1) AS source, NULL AS items FROM (
 SELECT file_id, trim(unnest(string_split(substr(line, 8), ','))) AS item FROM py_lines WHERE line LIKE 'import %')""",
)
view(
    "py_from_rows",
    r"""SELECT file_id, source AS name, source, array_to_string(list_transform(list_filter(list_transform(string_split(
  replace(replace(body, '(', ''), ')', ''), ','), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> ''),
  lambda x: regexp_extract(x, '(\S+)$', 1)), ',') AS items FROM (
 SELECT file_id, regexp_extract(m, '^from (\S+)', 1) AS source, regexp_extract(m, ' import ([\s\S]*)$', 1) AS body FROM (
 SELECT file_id, unnest(regexp_extract_all(content, '(?m)^from [^\n]+ import (?:\([^)]*\)|[^\n(]+)$')) AS m
 FROM code JOIN health USING (file_id) WHERE language = 'python' AND state = 'ok'))""",
)
oracle("py_imports", "SELECT file_id, name, source, items FROM py_import_rows")
oracle("py_from_imports", "SELECT file_id, name, source, items FROM py_from_rows")
view(
    "py_class_rows",
    r"""SELECT file_id, line_no, after, regexp_extract(line, '^class (\w+)', 1) AS name, replace(regexp_extract(line, '\(([^)]*)\)', 1), ', ', ',') AS bases
 FROM py_lines WHERE line LIKE 'class %'""",
)
oracle(
    "py_classes",
    """SELECT file_id, name, CASE WHEN bases <> 'Enum' THEN bases END AS bases, bases = 'Enum' AS is_enum FROM py_class_rows""",
)
view(
    "py_param_rows",
    r"""SELECT file_id, line_no, owner, name AS callable, i - 1 AS param_position, regexp_extract(ps[i], '^\*{0,2}(\w+)', 1) AS name,
  nullif(replace(regexp_extract(ps[i], '^\*{0,2}\w+: ([^=]+?)(?: = .*)?$', 1), ';', ','), '') AS type FROM (
 SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, list_filter(string_split(
  regexp_replace(params, '\[(\w+), (\w+)\]', '[\1; \2]', 'g'), ', '), lambda x: x <> '') AS ps FROM py_defs))""",
)
oracle("py_params", "SELECT file_id, owner, callable, param_position, name, type FROM py_param_rows")
oracle(
    "py_methods",
    """SELECT d.file_id, d.owner AS class_name, d.name, count(p.name) AS n_params FROM py_defs d
 LEFT JOIN py_param_rows p ON p.file_id = d.file_id AND p.line_no = d.line_no WHERE d.owner IS NOT NULL GROUP BY d.file_id, d.line_no, d.owner, d.name""",
)
oracle(
    "py_functions",
    """SELECT d.file_id, d.name, 'top' AS origin, string_agg(p.name, ',' ORDER BY p.param_position) AS params FROM py_defs d
 LEFT JOIN py_param_rows p ON p.file_id = d.file_id AND p.line_no = d.line_no WHERE d.owner IS NULL GROUP BY d.file_id, d.line_no, d.name""",
)
view(
    "py_doc_blocks",
    r"""SELECT file_id, line_no, array_to_string(list_transform(arr[line_no + 2 : line_no + stop], lambda x: regexp_replace(x, '^    ', '')), chr(10)) AS doc FROM (
 SELECT d.file_id, d.line_no, string_split(content, chr(10)) AS arr,
  list_position(list_transform(string_split(content, chr(10))[d.line_no + 2 :], lambda x: trim(x)), repeat('"', 3)) AS stop
 FROM py_lines d JOIN code USING (file_id) WHERE trim(d.after) = repeat('"', 3))""",
)
oracle(
    "py_docstrings",
    r"""SELECT h.file_id, h.kind, h.name, coalesce(b.doc, regexp_extract(ltrim(h.after), '^"{1,3}([^"]+)"', 1)) AS docstring FROM (
 SELECT file_id, line_no, name, after, CASE WHEN bases = 'Enum' THEN 'enum' ELSE 'class' END AS kind FROM py_class_rows
 UNION ALL SELECT file_id, line_no, name, after, CASE WHEN owner IS NULL THEN 'function' ELSE 'method' END FROM py_defs) h
 LEFT JOIN py_doc_blocks b USING (file_id, line_no) WHERE ltrim(h.after) LIKE '"%'""",
)
view(
    "py_variable_rows",
    r"""SELECT file_id, name, CASE WHEN regexp_matches(name, '^[A-Z_]*[A-Z][A-Z_]*$') THEN 'constant' ELSE 'external_variable' END AS kind,
 nullif(regexp_extract(line, '^\w+: (\w+) =', 1), '') AS type, CASE WHEN regexp_matches(v, '^[0-9.]+$') THEN v
  WHEN regexp_matches(v, '^"[^"]*"$') THEN substr(v, 2, length(v) - 2) END AS value FROM (
 SELECT *, regexp_extract(line, '^(\w+)', 1) AS name, regexp_extract(line, '= (.*)$', 1) AS v FROM py_lines WHERE regexp_matches(line, '^\w+(: \w+)? = '))""",
)
oracle("py_variables", "SELECT file_id, name, kind, type, value FROM py_variable_rows")
view(
    "py_assigned",
    r"""SELECT file_id, line_no, regexp_extract(top, '^class (\w+)', 1) AS owner, top LIKE '%(Enum):' AS is_enum, regexp_extract(line, '^    (\w+)', 1) AS name,
 nullif(regexp_extract(line, '^    \w+: (\w+) =', 1), '') AS type, regexp_extract(line, '= (.*)$', 1) AS v
 FROM py_lines WHERE top LIKE 'class %' AND regexp_matches(line, '^    \w+(: \w+)? = ')""",
)
oracle("py_attributes", "SELECT file_id, owner AS class_name, name, type, false AS static FROM py_assigned WHERE NOT is_enum")
oracle(
    "py_enums",
    """SELECT file_id, owner AS enum_name, row_number() OVER (PARTITION BY file_id, owner ORDER BY line_no) - 1 AS member_position,
 name AS member, replace(v, '"', '') AS value FROM py_assigned WHERE is_enum""",
)

# --- JavaScript --------------------------------------------------------------------

view(
    "js_import_rows",
    r"""SELECT file_id, CASE WHEN line LIKE 'import {%' THEN nullif(regexp_extract(line, 'default as (\w+)', 1), '') ELSE regexp_extract(line, '^import (?:\* as )?(\w+)', 1) END AS name,
 regexp_extract(line, 'from [''"]([^''"]+)', 1) AS source,
 CASE WHEN line LIKE 'import *%' THEN '*' WHEN line LIKE 'import {%' THEN array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(line, '\{([^}]*)\}', 1), ','), lambda x: trim(x)),
  lambda x: x NOT LIKE 'default as%'), lambda x: regexp_extract(x, '(\w+)$', 1)), ',') END AS items
 FROM js_lines WHERE level = 0 AND line LIKE 'import %'""",
)
oracle("js_imports", "SELECT file_id, name, source, items FROM js_import_rows")
view(
    "js_export_rows",
    r"""SELECT file_id, CASE WHEN line LIKE 'export {%' THEN NULL WHEN line LIKE 'export default%' THEN d ELSE n END AS name,
 CASE WHEN line LIKE 'export default%' THEN d ELSE 'self' END AS source,
 CASE WHEN line LIKE 'export {%' THEN array_to_string(list_transform(string_split(regexp_extract(line, '\{([^}]*)\}', 1), ','), lambda x: regexp_extract(trim(x), '(\w+)$', 1)), ',')
  WHEN line LIKE 'export default%' THEN 'default' ELSE n END AS items FROM (
 SELECT *, regexp_extract(line, '^export default (\w+)', 1) AS d, regexp_extract(line, '^export (?:const|let|var|function|class) (\w+)', 1) AS n
 FROM js_lines WHERE level = 0 AND line LIKE 'export %')""",
)
oracle("js_exports", "SELECT file_id, name, source, items FROM js_export_rows")
oracle(
    "js_classes",
    r"""SELECT file_id, regexp_extract(line, '^class (\w+)', 1) AS name, nullif(regexp_extract(line, ' extends ([\w.]+)', 1), '') AS bases
 FROM js_lines WHERE level = 0 AND line LIKE 'class %'""",
)
view(
    "js_callables",
    r"""SELECT file_id, line_no, regexp_extract(top, '^class (\w+)', 1) AS owner, regexp_extract(line, '(\w+)\(', 1) AS name, regexp_extract(line, '\(([^)]*)\)', 1) AS params, 'top' AS origin
  FROM js_lines WHERE level = 1 AND top LIKE 'class %' AND regexp_matches(line, '^  (async )?\w+\([^)]*\) \{')
 UNION ALL SELECT file_id, line_no, NULL, regexp_extract(line, '^(?:function )?(\w+)', 1), regexp_extract(line, '\(([^)]*)\)', 1), CASE WHEN line LIKE 'function %' THEN 'top' ELSE 'arrow' END
  FROM js_lines WHERE level = 0 AND regexp_matches(line, '^(function \w+\(|\w+ = \([^)]*\) =>)')""",
)
view(
    "js_param_rows",
    r"""SELECT file_id, line_no, owner, name AS callable, i - 1 AS param_position, regexp_extract(ps[i], '^((?:\.\.\.)?\w+)', 1) AS name FROM (
 SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, list_filter(string_split(params, ', '), lambda x: x <> '') AS ps FROM js_callables))""",
)
oracle("js_params", "SELECT file_id, owner, callable, param_position, name, CAST(NULL AS VARCHAR) AS type FROM js_param_rows")
oracle(
    "js_methods",
    """SELECT d.file_id, d.owner AS class_name, d.name, count(p.name) AS n_params FROM js_callables d
 LEFT JOIN js_param_rows p USING (file_id, line_no) WHERE d.owner IS NOT NULL GROUP BY d.file_id, line_no, d.owner, d.name""",
)
oracle(
    "js_functions",
    """SELECT d.file_id, d.name, d.origin, string_agg(p.name, ',' ORDER BY p.param_position) AS params FROM js_callables d
 LEFT JOIN js_param_rows p USING (file_id, line_no) WHERE d.owner IS NULL GROUP BY d.file_id, line_no, d.name, d.origin""",
)
oracle(
    "js_fields",
    r"""SELECT file_id, regexp_extract(top, '^class (\w+)', 1) AS class_name, regexp_extract(line, '(\w+) =', 1) AS name, CAST(NULL AS VARCHAR) AS type, line LIKE '  static %' AS static
 FROM js_lines WHERE level = 1 AND top LIKE 'class %' AND regexp_matches(line, '^  (static )?\w+ = ')""",
)
view(
    "js_variable_rows",
    r"""SELECT file_id, regexp_extract(line, '^\w+ (\w+)', 1) AS name, CASE WHEN line LIKE 'const %' THEN 'constant' ELSE 'external_variable' END AS kind, CAST(NULL AS VARCHAR) AS type,
 replace(regexp_extract(line, '= (.*);$', 1), '"', '') AS value FROM js_lines WHERE level = 0 AND regexp_matches(line, '^(const|let|var) ')""",
)
oracle("js_variables", "SELECT file_id, name, kind, type, value FROM js_variable_rows")
oracle(
    "js_page_variables",
    r"""SELECT page_id, i - 1 AS script_no, regexp_extract(s, '^var (\w+)', 1) AS name, 'external_variable' AS kind, regexp_extract(s, '="([^"]*)"', 1) AS value FROM (
 SELECT page_id, i, ss[i] AS s FROM (SELECT page_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (
 SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS ss FROM pages))) WHERE regexp_matches(s, '^var ')""",
)
_CLEAN = r"""trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(trim(regexp_extract(m, '(/\*\*[\s\S]*\*/)', 1)), '^/\*\*', ''), '\*/$', ''), chr(10)),
  lambda x: trim(regexp_replace(trim(x), '^\*', ''))), chr(10)), concat(' ', chr(10)))"""
oracle(
    "js_docstrings",
    rf"""SELECT file_id, CASE WHEN h LIKE 'class %' THEN 'class' WHEN h LIKE 'function %' THEN 'function' ELSE 'method' END AS kind,
 regexp_extract(h, '^(?:class |function )?(\w+)', 1) AS name, {_CLEAN} AS docstring FROM (
 SELECT file_id, m, trim(regexp_extract(m, '([^\n]*)$', 1)) AS h FROM (
 SELECT file_id, unnest(regexp_extract_all(content, '/\*\*[^/]*\*/\n[^\n]*')) AS m FROM code JOIN health USING (file_id) WHERE language = 'javascript' AND state = 'ok'))""",
)

# --- C++ ---------------------------------------------------------------------------

view(
    "cpp_include_rows",
    """SELECT file_id, regexp_extract(line, '[<"]([^>"]+)', 1) AS name, regexp_extract(line, '[<"]([^>"]+)', 1) AS source, CAST(NULL AS VARCHAR) AS items FROM cpp_lines WHERE line LIKE '#include%'""",
)
oracle("cpp_includes", "SELECT file_id, name, source, items FROM cpp_include_rows")
view(
    "cpp_base_rows",
    r"""SELECT file_id, line_no, name, i - 1 AS base_position, regexp_extract(bs[i], '(\w+)$', 1) AS base,
  coalesce(nullif(regexp_extract(bs[i], '^(public|protected|private) ', 1), ''), CASE WHEN kw = 'class' THEN 'private' ELSE 'public' END) AS access, i = len(bs) AS is_last FROM (
 SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM (SELECT *, list_filter(string_split(regexp_extract(line, ' : ([^{]*?) \{', 1), ', '), lambda x: x <> '') AS bs FROM cpp_class_rows))""",
)
view(
    "cpp_class_rows",
    r"""SELECT file_id, line_no, line, regexp_extract(line, '^(class|struct)', 1) AS kw, regexp_extract(line, '^\w+ (\w+)', 1) AS name FROM cpp_lines WHERE level = 0 AND regexp_matches(line, '^(class|struct) ')""",
)
oracle("cpp_bases", "SELECT file_id, name AS class_name, base_position, base, access, is_last FROM cpp_base_rows")
oracle(
    "cpp_classes",
    """SELECT c.file_id, c.name, string_agg(b.access || ' ' || b.base, ',' ORDER BY b.base_position) AS bases FROM cpp_class_rows c
 LEFT JOIN cpp_base_rows b USING (file_id, line_no) GROUP BY c.file_id, line_no, c.name""",
)
view(
    "cpp_callables",
    r"""SELECT file_id, line_no, regexp_extract(top, '^\w+ (\w+)', 1) AS owner, regexp_extract(line, '(\w+)\(', 1) AS name, regexp_extract(line, '\(([^)]*)\)', 1) AS params
  FROM cpp_lines WHERE level = 1 AND regexp_matches(top, '^(class|struct) ') AND regexp_matches(line, '^  (\w+ )?\w+\(')
 UNION ALL SELECT file_id, line_no, NULL, regexp_extract(line, '(\w+)\(', 1), regexp_extract(line, '\(([^)]*)\)', 1)
  FROM cpp_lines WHERE level = 0 AND regexp_matches(line, '^\w+ \w+\(')""",
)
view(
    "cpp_param_rows",
    r"""SELECT file_id, line_no, owner, name AS callable, i - 1 AS param_position, CASE WHEN p = '...' THEN '...' ELSE regexp_extract(p, '(\w+)$', 1) END AS name,
  CASE WHEN p = '...' THEN '...' ELSE replace(regexp_replace(regexp_replace(p, '^const ', ''), '\w+$', ''), ' ', '') END AS type FROM (
 SELECT *, regexp_replace(ps[i], ' = .*$', '') AS p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, list_filter(string_split(params, ', '), lambda x: x <> '') AS ps FROM cpp_callables)))""",
)
oracle("cpp_params", "SELECT file_id, owner, callable, param_position, name, type FROM cpp_param_rows")
oracle(
    "cpp_methods",
    """SELECT d.file_id, d.owner AS class_name, d.name, count(p.name) AS n_params FROM cpp_callables d
 LEFT JOIN cpp_param_rows p USING (file_id, line_no) WHERE d.owner IS NOT NULL GROUP BY d.file_id, line_no, d.owner, d.name""",
)
oracle(
    "cpp_functions",
    """SELECT d.file_id, d.name, 'top' AS origin, string_agg(p.name, ',' ORDER BY p.param_position) AS params FROM cpp_callables d
 LEFT JOIN cpp_param_rows p USING (file_id, line_no) WHERE d.owner IS NULL GROUP BY d.file_id, line_no, d.name""",
)
oracle(
    "cpp_fields",
    r"""SELECT file_id, regexp_extract(top, '^\w+ (\w+)', 1) AS class_name, regexp_extract(line, '^  \w+ (\w+)', 1) AS name, regexp_extract(line, '^  (\w+)', 1) AS type, false AS static
 FROM cpp_lines WHERE level = 1 AND regexp_matches(top, '^(class|struct) ') AND regexp_matches(line, '^  \w+ \w+( = .*)?;$')""",
)
view(
    "cpp_variable_rows",
    r"""SELECT file_id, name, CASE WHEN type LIKE '%const%' THEN 'constant' ELSE 'external_variable' END AS kind, type, value FROM (
 SELECT file_id, regexp_extract(line, '(\w+)(?: = .*)?;$', 1) AS name, regexp_extract(line, '^((?:const |static |extern )?\w+) ', 1) AS type, nullif(regexp_extract(line, ' = (.*);$', 1), '') AS value
 FROM cpp_lines WHERE level = 0 AND regexp_matches(line, '^(const |static |extern )?\w+ \w+( = [^{]*)?;$'))""",
)
oracle("cpp_variables", "SELECT file_id, name, kind, type, value FROM cpp_variable_rows")
oracle(
    "cpp_enums",
    r"""SELECT file_id, enum_name, i - 1 AS member_position, regexp_extract(ms[i], '^(\w+)', 1) AS member, nullif(regexp_extract(ms[i], '= (.*)$', 1), '') AS value FROM (
 SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT file_id, regexp_extract(line, '^enum (?:class )?(\w+)', 1) AS enum_name,
  list_transform(string_split(regexp_extract(line, '\{([^}]*)\}', 1), ','), lambda x: trim(x)) AS ms FROM cpp_lines WHERE line LIKE 'enum %'))""",
)
oracle(
    "cpp_docstrings",
    rf"""SELECT file_id, CASE WHEN regexp_matches(h, '^(class|struct) ') THEN 'class' WHEN inner_line THEN 'method' ELSE 'function' END AS kind,
 CASE WHEN regexp_matches(h, '^(class|struct) ') THEN regexp_extract(h, '^\w+ (\w+)', 1) ELSE regexp_extract(h, '(\w+)\(', 1) END AS name,
 CASE WHEN m LIKE '/**%' THEN {_CLEAN} ELSE array_to_string(list_transform(regexp_extract_all(m, '//[^\n]*'), lambda x: trim(substr(x, 3))), chr(10)) END AS docstring FROM (
 SELECT file_id, trim(m) AS m, trim(regexp_extract(m, '([^\n]*)$', 1)) AS h, m LIKE ' %' AS inner_line FROM (
 SELECT file_id, unnest(regexp_extract_all(content, '(?m)(?:^/\*\*[^/]*\*/\n|(?:^ *//[^\n]*\n)+)[^\n]*')) AS m FROM code JOIN health USING (file_id) WHERE language = 'cpp' AND state = 'ok'))""",
)

# --- Julia -------------------------------------------------------------------------

view(
    "jl_import_rows",
    r"""SELECT file_id, CAST(NULL AS VARCHAR) AS name, regexp_extract(line, '^\w+ ([\w.]+)', 1) AS source, nullif(replace(regexp_extract(line, ': (.*)$', 1), ', ', ','), '') AS items FROM jl_lines
  WHERE level = 0 AND regexp_matches(line, '^(using|import) ')
 UNION ALL SELECT file_id, NULL, name, NULL FROM jl_fallback SEMI JOIN jl_saved USING (file_id) WHERE kind = 'import'""",
)
oracle("jl_imports", "SELECT file_id, name, source, items FROM jl_import_rows")
view(
    "jl_callables",
    r"""SELECT file_id, line_no, trim(line) AS line, before, CASE WHEN nest THEN 'nested' WHEN in_module THEN 'module' ELSE 'top' END AS origin,
  CASE WHEN trim(line) LIKE 'macro %' THEN concat('@', n) ELSE n END AS name, regexp_extract(line, '\(([^)]*)\)', 1) AS params FROM (
 SELECT *, level > 0 AS nest, regexp_extract(line, '^\s*(?:function |macro )?(\w+)\(', 1) AS n FROM jl_lines
 WHERE regexp_matches(line, '^\s*((function|macro) \w+\(|\w+\([^)]*\) = )') AND (level = 0 OR block LIKE 'function %' OR (in_module AND level > 0)))""",
)
view(
    "jl_function_rows",
    r"""SELECT d.file_id, d.name, d.origin, string_agg(p.name, ',' ORDER BY p.param_position) AS params FROM jl_callables d
  LEFT JOIN jl_param_rows p USING (file_id, line_no) GROUP BY d.file_id, line_no, d.name, d.origin
 UNION ALL SELECT file_id, name, 'fallback', NULL FROM jl_fallback SEMI JOIN jl_saved USING (file_id) WHERE kind IN ('function', 'macro')""",
)
view(
    "jl_all_callables",
    r"""SELECT file_id, line_no, CAST(NULL AS VARCHAR) AS owner, name, params FROM jl_callables
 UNION ALL SELECT file_id, line_no, regexp_extract(block, 'struct (\w+)', 1), regexp_extract(line, '^\s*(\w+)\(', 1), regexp_extract(line, '\(([^)]*)\)', 1) FROM jl_lines
  WHERE regexp_matches(block, '^(mutable )?struct ') AND depth = 1 AND regexp_matches(line, '^\s*\w+\([^)]*\) = ')""",
)
view(
    "jl_param_rows",
    r"""SELECT file_id, line_no, owner, name AS callable, i - 1 AS param_position, regexp_extract(ps[i], '^(\w+)', 1) AS name, nullif(regexp_extract(ps[i], '::(\w+)(?:=.*)?$', 1), '') AS type FROM (
 SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, list_filter(list_transform(string_split(replace(params, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM jl_all_callables))""",
)
oracle("jl_params", "SELECT file_id, owner, callable, param_position, name, type FROM jl_param_rows")
oracle("jl_functions", "SELECT file_id, name, origin, params FROM jl_function_rows WHERE name NOT LIKE '@%' AND origin <> 'nested'")
oracle("jl_macros", "SELECT file_id, name, origin, params FROM jl_function_rows WHERE name LIKE '@%'")
oracle("jl_nested", "SELECT file_id, name, origin, params FROM jl_function_rows WHERE origin = 'nested'")
view(
    "jl_struct_rows",
    r"""SELECT file_id, regexp_extract(line, 'struct (\w+)', 1) AS name, nullif(regexp_extract(line, '<: (\w+)', 1), '') AS bases FROM jl_lines WHERE level = 0 AND regexp_matches(line, '^(mutable )?struct ')
 UNION ALL SELECT file_id, name, NULL FROM jl_fallback SEMI JOIN jl_saved USING (file_id) WHERE kind = 'struct'""",
)
oracle("jl_structs", "SELECT file_id, name, bases FROM jl_struct_rows")
oracle(
    "jl_fields",
    r"""SELECT file_id, regexp_extract(block, 'struct (\w+)', 1) AS class_name, regexp_extract(line, '^\s+(\w+)::', 1) AS name, nullif(regexp_extract(line, '::(\w+)$', 1), '') AS type, false AS static
 FROM jl_lines WHERE depth = 1 AND regexp_matches(block, '^(mutable )?struct ') AND regexp_matches(line, '^\s+\w+::')""",
)
oracle(
    "jl_constructors",
    """SELECT d.file_id, d.owner AS class_name, d.name, count(p.name) AS n_params FROM jl_all_callables d
 LEFT JOIN jl_param_rows p USING (file_id, line_no) WHERE d.owner IS NOT NULL GROUP BY d.file_id, line_no, d.owner, d.name""",
)
view(
    "jl_variable_rows",
    r"""SELECT file_id, name, kind, CAST(NULL AS VARCHAR) AS type, CASE WHEN regexp_matches(v, '^([0-9.]+|"[^"]*")$') THEN v END AS value FROM (
 SELECT file_id, regexp_extract(line, '^(?:const )?(\w+) =', 1) AS name, CASE WHEN line LIKE 'const %' THEN 'constant' WHEN regexp_matches(line, '(Vector|Matrix|Array|Dict|Set|Tuple)\{') THEN 'type_alias' ELSE 'external_variable' END AS kind,
  regexp_extract(line, '= (.*)$', 1) AS v FROM jl_lines WHERE level = 0 AND regexp_matches(line, '^(const )?\w+ = '))
 UNION ALL SELECT file_id, name, 'constant', NULL, NULL FROM jl_fallback SEMI JOIN jl_saved USING (file_id) WHERE kind = 'constant'""",
)
oracle("jl_variables", "SELECT file_id, name, kind, type, value FROM jl_variable_rows")
oracle(
    "jl_docstrings",
    """SELECT file_id, 'function' AS kind, name, replace(before, '"', '') AS docstring FROM jl_callables WHERE before LIKE '"%"'""",
)
oracle(
    "jl_modules",
    r"""SELECT file_id, regexp_extract(block, '^module (\w+)', 1) AS module, CASE WHEN regexp_matches(line, '^(using|import) ') THEN 'import' WHEN line LIKE 'function %' THEN 'function' ELSE 'constant' END AS kind,
 regexp_extract(line, '^\w+ ([\w.]+)', 1) AS name FROM jl_lines WHERE in_module AND level = 0 AND regexp_matches(line, '^(using|import|function|const) ')""",
)
oracle(
    "triage",
    r"""SELECT file_id, regexp_matches(c, 'function\s+\w+\s*\([^)]*$') AS unclosed_function,
 c LIKE '%struct %' AND len(string_split(c, 'struct')) > len(string_split(c, 'end')) AS unclosed_struct, length(c) < 5 AS too_short FROM (
 SELECT file_id, trim(array_to_string(list_transform(string_split(trim(content, concat(' ', chr(10))), chr(10)), lambda x: trim(x)), chr(10)), concat(' ', chr(10))) AS c FROM code WHERE language = 'julia')""",
)
oracle("jl_regex_fallback", "SELECT file_id, kind, name FROM jl_fallback")
view(
    "jl_primary",
    """SELECT file_id, 'function' AS kind, name FROM jl_callables
 UNION ALL SELECT file_id, 'struct', name FROM jl_struct_rows ANTI JOIN jl_saved USING (file_id)
 UNION ALL SELECT file_id, 'constant', name FROM jl_variable_rows ANTI JOIN jl_saved USING (file_id)
 UNION ALL SELECT file_id, 'import', source FROM jl_import_rows ANTI JOIN jl_saved USING (file_id)""",
)
oracle(
    "jl_merge",
    """SELECT file_id, kind, name, 'primary' AS origin FROM jl_primary
 UNION ALL SELECT file_id, CASE WHEN f.kind = 'macro' THEN 'function' ELSE f.kind END, name, 'fallback' FROM jl_fallback f
 WHERE NOT EXISTS (SELECT 1 FROM jl_primary p WHERE p.file_id = f.file_id AND p.name = f.name AND p.kind = CASE WHEN f.kind = 'macro' THEN 'function' ELSE f.kind END)""",
)

# --- classification and compaction -------------------------------------------------

view(
    "import_rows",
    """SELECT file_id, name, source, items FROM py_import_rows UNION ALL SELECT file_id, name, source, items FROM py_from_rows
 UNION ALL SELECT file_id, name, source, items FROM js_import_rows UNION ALL SELECT file_id, name, source, items FROM js_export_rows
 UNION ALL SELECT file_id, name, source, items FROM cpp_include_rows UNION ALL SELECT file_id, name, source, items FROM jl_import_rows""",
)
view(
    "root_rows",
    """SELECT DISTINCT file_id, root FROM (SELECT file_id, string_split(string_split(source, '/')[1], '.')[1] AS root FROM import_rows
 UNION ALL SELECT file_id, string_split(name, '.')[1] FROM import_rows WHERE items IS NULL AND (name = source OR source IS NULL)) WHERE root <> ''""",
)
oracle("import_roots", "SELECT file_id, root FROM root_rows")
_INDICATORS = """(VALUES (1, 'django', 'web_framework'), (2, 'flask', 'web_framework'), (3, 'react', 'web_framework'), (4, 'angular', 'web_framework'),
 (5, 'vue', 'web_framework'), (6, 'express', 'web_framework'), (7, 'pytest', 'test'), (8, 'unittest', 'test'), (9, 'jest', 'test'), (10, 'mocha', 'test'),
 (11, 'sqlalchemy', 'database'), (12, 'mongoose', 'database'), (13, 'sequelize', 'database'), (14, 'pandas', 'data_processing'), (15, 'numpy', 'data_processing'),
 (16, 'tensorflow', 'ml'), (17, 'torch', 'ml'), (18, 'sklearn', 'ml')) AS i(rank, word, category)"""
view("by_import", f"SELECT file_id, arg_min(category, rank) AS category FROM root_rows JOIN {_INDICATORS} ON contains(lower(root), word) GROUP BY file_id")
oracle("category_imports", "SELECT file_id, category FROM by_import")
_BY_PATH = r"""CASE WHEN regexp_matches(lower(path), 'util|helper|lib') THEN 'util' WHEN regexp_matches(lower(path), 'test|spec') THEN 'test'
 WHEN regexp_matches(lower(path), 'conf|setup') THEN 'config' WHEN regexp_matches(lower(path), 'model|schema') THEN 'model'
 WHEN regexp_matches(lower(path), 'controller|handler|route') THEN 'controller' WHEN contains(lower(path), 'service') THEN 'service'
 WHEN regexp_matches(lower(path), 'component|view') THEN 'ui_component' WHEN regexp_matches(path, '(^|/)__init__\.py$') THEN 'package_init'
 WHEN regexp_matches(path, '(^|/)(main\.js|index\.js|app\.js|server\.js|cli\.js|main\.py|cli\.py)$') THEN 'entrypoint' ELSE 'unknown' END"""
oracle("category_path", f"SELECT file_id, repo, path, {_BY_PATH} AS category FROM all_paths")
view(
    "chosen",
    """SELECT c.* FROM code c ANTI JOIN ignored_paths i USING (file_id, repo, path) ANTI JOIN default_out d USING (file_id, repo, path) WHERE language IS NOT NULL""",
)
view(
    "kb_rows",
    f"""SELECT c.file_id, c.repo, c.path, c.language, coalesce(b.category, {_BY_PATH.replace("path", "c.path")}) AS category
 FROM chosen c JOIN health h USING (file_id) LEFT JOIN by_import b USING (file_id) WHERE h.state IN ('ok', 'recovered')""",
)
oracle("file_category", "SELECT file_id, repo, path, category FROM kb_rows")
oracle("category_counts", "SELECT repo, category, count(*) AS n_files FROM kb_rows GROUP BY repo, category")
oracle(
    "imports_compact",
    """SELECT file_id, CASE WHEN name = source AND items IS NULL THEN concat('"', name, '"') ELSE concat('{', concat_ws(',',
  CASE WHEN name IS NOT NULL THEN concat('"name":"', name, '"') END, CASE WHEN name IS NULL OR name <> source THEN concat('"source":"', source, '"') END,
  CASE WHEN items IS NOT NULL AND items <> '' THEN concat('"items":["', replace(items, ',', '","'), '"]') END), '}') END AS compact FROM import_rows""",
)
view(
    "variable_rows",
    """SELECT file_id, 'python' AS language, kind, value FROM py_variable_rows UNION ALL SELECT file_id, 'javascript', kind, value FROM js_variable_rows
 UNION ALL SELECT file_id, 'cpp', kind, value FROM cpp_variable_rows UNION ALL SELECT file_id, 'julia', kind, value FROM jl_variable_rows""",
)
oracle(
    "variables_kept",
    "SELECT language, kind, count(*) AS n FROM variable_rows WHERE coalesce(value, '') <> '' OR kind <> 'external_variable' GROUP BY language, kind",
)
oracle(
    "params_kept",
    """SELECT language, name, count(*) AS n FROM (SELECT 'python' AS language, name FROM py_param_rows UNION ALL SELECT 'javascript', name FROM js_param_rows
 UNION ALL SELECT 'cpp', name FROM cpp_param_rows UNION ALL SELECT 'julia', name FROM jl_param_rows) WHERE name <> 'self' GROUP BY language, name""",
)
view(
    "fact_rows",
    r"""SELECT 'python' AS language, 'import' AS kind, source AS name FROM py_import_rows UNION ALL SELECT 'python', 'import', source FROM py_from_rows
 UNION ALL SELECT 'python', CASE WHEN bases = 'Enum' THEN 'enum' ELSE 'class' END, name FROM py_class_rows
 UNION ALL SELECT 'python', CASE WHEN owner IS NULL THEN 'function' ELSE 'method' END, name FROM py_defs
 UNION ALL SELECT 'python', 'attribute', name FROM py_assigned WHERE NOT is_enum UNION ALL SELECT 'python', kind, name FROM py_variable_rows
 UNION ALL SELECT 'javascript', 'import', source FROM js_import_rows UNION ALL SELECT 'javascript', 'export', source FROM js_export_rows
 UNION ALL SELECT 'javascript', 'class', regexp_extract(line, '^class (\w+)', 1) FROM js_lines WHERE level = 0 AND line LIKE 'class %'
 UNION ALL SELECT 'javascript', CASE WHEN owner IS NULL THEN 'function' ELSE 'method' END, name FROM js_callables
 UNION ALL SELECT 'javascript', 'attribute', regexp_extract(line, '(\w+) =', 1) FROM js_lines WHERE level = 1 AND top LIKE 'class %' AND regexp_matches(line, '^  (static )?\w+ = ')
 UNION ALL SELECT 'javascript', kind, name FROM js_variable_rows
 UNION ALL SELECT 'cpp', 'import', source FROM cpp_include_rows UNION ALL SELECT 'cpp', 'class', name FROM cpp_class_rows
 UNION ALL SELECT 'cpp', CASE WHEN owner IS NULL THEN 'function' ELSE 'method' END, name FROM cpp_callables
 UNION ALL SELECT 'cpp', 'attribute', regexp_extract(line, '^  \w+ (\w+)', 1) FROM cpp_lines WHERE level = 1 AND regexp_matches(top, '^(class|struct) ') AND regexp_matches(line, '^  \w+ \w+( = .*)?;$')
 UNION ALL SELECT 'cpp', kind, name FROM cpp_variable_rows UNION ALL SELECT 'cpp', 'enum', regexp_extract(line, '^enum (?:class )?(\w+)', 1) FROM cpp_lines WHERE line LIKE 'enum %'
 UNION ALL SELECT 'julia', 'import', source FROM jl_import_rows UNION ALL SELECT 'julia', 'class', name FROM jl_struct_rows UNION ALL SELECT 'julia', 'function', name FROM jl_function_rows
 UNION ALL SELECT 'julia', 'method', name FROM jl_all_callables WHERE owner IS NOT NULL
 UNION ALL SELECT 'julia', 'attribute', regexp_extract(line, '^\s+(\w+)::', 1) FROM jl_lines WHERE depth = 1 AND regexp_matches(block, '^(mutable )?struct ') AND regexp_matches(line, '^\s+\w+::')
 UNION ALL SELECT 'julia', kind, name FROM jl_variable_rows""",
)
oracle("all_facts", "SELECT language, kind, count(*) AS n, count(DISTINCT name) AS n_names FROM fact_rows GROUP BY language, kind")
oracle("quarantine", "SELECT file_id, repo, path, 'syntax error: unbalanced brackets' AS reason FROM code JOIN health USING (file_id) WHERE state = 'failed'")
oracle(
    "kb_export",
    """SELECT file_id, repo, path, state <> 'failed' AS analyzed, CASE WHEN state = 'failed' THEN 'syntax error: unbalanced brackets' END AS reason
 FROM chosen JOIN health USING (file_id)""",
)
view(
    "keyed",
    r"""SELECT *, regexp_replace(path, '\.[^./]*$', '') AS kb_key FROM kb_rows""",
)
view(
    "kept_rows",
    "SELECT repo, kb_key, count(*) AS n_files, max(path) AS path, arg_max(file_id, (path, file_id)) AS file_id FROM keyed GROUP BY repo, kb_key",
)
oracle("kb_collisions", "SELECT repo, kb_key, n_files, path, file_id FROM kept_rows WHERE n_files > 1")
oracle(
    "build_summary",
    """SELECT repo, status, count(*) AS n_files FROM (SELECT c.repo, CASE WHEN d.file_id IS NOT NULL THEN 'excluded directory' WHEN i.file_id IS NOT NULL THEN 'ignored by pattern'
  WHEN c.language IS NULL THEN 'not source' WHEN h.state = 'failed' THEN 'analysis failed' ELSE 'analyzed' END AS status
 FROM code c JOIN health h USING (file_id) LEFT JOIN default_out d USING (file_id, repo, path) LEFT JOIN ignored_paths i USING (file_id, repo, path)) GROUP BY repo, status""",
)
view(
    "kb_counts",
    """SELECT k.file_id, (SELECT count(*) FROM import_rows r WHERE r.file_id = k.file_id) AS n_imports,
 (SELECT count(*) FROM (SELECT file_id FROM py_class_rows WHERE bases <> 'Enum' UNION ALL SELECT file_id FROM js_lines WHERE level = 0 AND line LIKE 'class %'
  UNION ALL SELECT file_id FROM cpp_class_rows UNION ALL SELECT file_id FROM jl_struct_rows) r WHERE r.file_id = k.file_id) AS n_classes,
 (SELECT count(*) FROM (SELECT file_id FROM py_defs WHERE owner IS NULL UNION ALL SELECT file_id FROM js_callables WHERE owner IS NULL
  UNION ALL SELECT file_id FROM cpp_callables WHERE owner IS NULL UNION ALL SELECT file_id FROM jl_function_rows) r WHERE r.file_id = k.file_id) AS n_functions,
 (SELECT count(*) FROM variable_rows r WHERE r.file_id = k.file_id AND (coalesce(value, '') <> '' OR kind <> 'external_variable')) AS n_variables FROM kb_rows k""",
)
oracle(
    "kb_compact",
    """SELECT repo, concat(kb_key, '.json') AS json_path, n_imports, n_classes, n_functions, n_variables, nullif(category, 'unknown') AS category, true AS no_enums
 FROM keyed JOIN kb_counts USING (file_id)""",
)
oracle(
    "kb_files",
    """SELECT r.file_id, r.repo, concat(r.kb_key, '.json') AS json_path, 'written' AS status, r.path, n_functions
 FROM kept_rows r JOIN kb_counts c USING (file_id)""",
)
oracle(
    "kb_incremental",
    """SELECT k.file_id, k.repo, k.path, k.category, c.n_imports FROM kb_rows k JOIN kb_counts c USING (file_id)
 JOIN (SELECT repo, path, max(file_id) AS file_id FROM chosen GROUP BY repo, path) m ON m.file_id = k.file_id""",
)

# --- changes -----------------------------------------------------------------------

view(
    "answers",
    r"""SELECT s.file_id, s.path, k.file_id AS kb_file_id, k.path AS kb_path, r.category FROM (SELECT file_id, repo, path, regexp_replace(path, '\.[^./]*$', '') AS kb_key FROM source_files) s
 LEFT JOIN kept_rows k USING (repo, kb_key) LEFT JOIN kb_rows r ON r.file_id = k.file_id""",
)
view(
    "looked_up",
    "SELECT c.commit_id, c.file_id, c.seq, coalesce(a.path, concat('missing/p_', CAST(c.file_id AS VARCHAR))) AS path, a.kb_file_id, a.kb_path, a.category FROM changes c LEFT JOIN answers a USING (file_id)",
)
oracle("change_context", "SELECT commit_id, file_id, path, kb_path, category FROM looked_up")
oracle("unanalyzed_changes", "SELECT commit_id, file_id FROM looked_up WHERE kb_file_id IS NULL")
view(
    "scopes",
    """SELECT commit_id, CASE WHEN n = 1 THEN regexp_extract(one, '([^/]*)$', 1) ELSE coalesce(lo[shared], '') END AS scope FROM (
 SELECT *, coalesce(list_max(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0) AS shared FROM (
 SELECT commit_id, count(*) AS n, min(string_split(path, '/')) AS lo, max(string_split(path, '/')) AS hi, max(path) AS one FROM looked_up GROUP BY commit_id))""",
)
oracle("commit_scope", "SELECT commit_id, scope FROM scopes")
oracle(
    "kb_staleness",
    """SELECT s.repo, CASE WHEN m.commit_id IS NOT NULL THEN (SELECT count(*) FROM commits c WHERE c.repo = s.repo AND (c.commit_ts, c.commit_id) > (m.commit_ts, m.commit_id)) END AS behind,
 CASE WHEN m.commit_id IS NULL THEN true ELSE (SELECT count(*) FROM commits c WHERE c.repo = s.repo AND (c.commit_ts, c.commit_id) > (m.commit_ts, m.commit_id)) > 5 END AS stale
 FROM kb_snapshots s LEFT JOIN commits m ON m.repo = s.repo AND m.commit_id = s.stored_commit""",
)

# --- completions -------------------------------------------------------------------

view(
    "json_rows",
    r"""SELECT conv_id, turn, coalesce(nullif(regexp_extract(completion, '(?i)```(?:json)?\s*(\{[\s\S]*?\})\s*```', 1), ''), nullif(regexp_extract(completion, '(\{[^{}]*\})[^{]*$', 1), '')) AS json FROM completions""",
)
oracle("completion_json", "SELECT conv_id, turn, json FROM json_rows")
view(
    "record_rows",
    """SELECT conv_id, turn, CASE WHEN json IS NULL THEN 'extraction failed' WHEN NOT json_valid(json) THEN 'invalid record' WHEN coalesce(json_type(json, '$.type') = 'VARCHAR' AND json_type(json, '$.description') = 'VARCHAR', false) THEN 'parsed' ELSE 'invalid record' END AS outcome,
 json_extract_string(json, '$.type') AS type, json_extract_string(json, '$.scope') AS scope, json_extract_string(json, '$.description') AS description, json_extract_string(json, '$.body') AS body FROM json_rows""",
)
oracle("completion_parsed", "SELECT conv_id, turn, outcome, CAST(0 AS BIGINT) AS attempt, type, scope, description, body FROM record_rows")
oracle("completion_retries", "SELECT conv_id, turn, outcome, CAST(1 AS BIGINT) AS attempt FROM record_rows WHERE outcome <> 'parsed'")
view(
    "second_rows",
    r"""SELECT conv_id, turn, CASE WHEN json IS NULL THEN 'extraction failed' WHEN json_type(json, '$.type') = 'VARCHAR' THEN 'parsed' ELSE 'invalid record' END AS outcome, json
 FROM (SELECT DISTINCT conv_id, turn, nullif(regexp_extract(completion, '(\{[^{}]*\})[^{]*$', 1), '') AS json FROM retry_answers) s""",
)
view(
    "ledger_rows",
    """SELECT r.conv_id, r.turn, CASE WHEN s.conv_id IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS attempt, coalesce(s.outcome, r.outcome) AS outcome,
 r.outcome = 'parsed' OR s.conv_id IS NOT NULL AS final,
 CASE WHEN s.conv_id IS NULL THEN r.type WHEN s.outcome = 'parsed' THEN json_extract_string(s.json, '$.type') END AS type,
 CASE WHEN s.conv_id IS NULL THEN r.scope WHEN s.outcome = 'parsed' THEN json_extract_string(s.json, '$.scope') END AS scope,
 CASE WHEN s.conv_id IS NULL THEN r.description WHEN s.outcome = 'parsed' THEN json_extract_string(s.json, '$.description') END AS description,
 CASE WHEN s.conv_id IS NULL THEN r.body WHEN s.outcome = 'parsed' THEN json_extract_string(s.json, '$.body') END AS body
 FROM record_rows r LEFT JOIN second_rows s ON r.outcome <> 'parsed' AND s.conv_id = r.conv_id AND s.turn = r.turn""",
)
oracle("completion_ledger", "SELECT conv_id, turn, attempt, outcome, final, type, scope, description, body FROM ledger_rows")
view(
    "retried_rows",
    """SELECT conv_id, turn, attempt, type NOT IN ('feat', 'fix', 'docs', 'style', 'refactor', 'test', 'chore') AS invalid_type,
 CASE WHEN outcome = 'parsed' AND trim(description) = '' THEN 'blank description' ELSE outcome END AS outcome,
 CASE WHEN outcome = 'parsed' AND trim(description) <> '' THEN concat(CASE WHEN type IN ('feat', 'fix', 'docs', 'style', 'refactor', 'test', 'chore') THEN type ELSE 'feat' END, CASE WHEN scope <> '' THEN concat('(', scope, ')') ELSE '' END, ': ', trim(description),
  CASE WHEN trim(body) <> '' THEN concat(chr(10), chr(10), trim(body)) ELSE '' END) END AS commit_message FROM ledger_rows""",
)
oracle("retry_messages", "SELECT conv_id, turn, attempt, outcome, commit_message FROM retried_rows")
oracle(
    "retry_outcomes",
    "SELECT CASE WHEN outcome = 'parsed' AND invalid_type THEN 'parsed, type replaced' ELSE outcome END AS outcome, count(*) AS n FROM retried_rows GROUP BY 1",
)
view(
    "typed_rows",
    "SELECT *, type NOT IN ('feat', 'fix', 'docs', 'style', 'refactor', 'test', 'chore') AS invalid_type FROM record_rows",
)
oracle("type_normalised", "SELECT conv_id, turn, CASE WHEN invalid_type THEN 'feat' ELSE type END AS type, invalid_type FROM typed_rows WHERE type IS NOT NULL")
view(
    "message_rows",
    """SELECT conv_id, turn, invalid_type, CASE WHEN outcome = 'parsed' AND trim(description) = '' THEN 'blank description' ELSE outcome END AS outcome,
 CASE WHEN outcome = 'parsed' AND trim(description) <> '' THEN concat(CASE WHEN invalid_type THEN 'feat' ELSE type END, CASE WHEN scope <> '' THEN concat('(', scope, ')') ELSE '' END, ': ', trim(description),
  CASE WHEN trim(body) <> '' THEN concat(chr(10), chr(10), trim(body)) ELSE '' END) END AS commit_message FROM typed_rows""",
)
oracle("commit_message", "SELECT conv_id, turn, outcome, commit_message FROM message_rows")
oracle(
    "completion_outcomes",
    "SELECT CASE WHEN outcome = 'parsed' AND invalid_type THEN 'parsed, type replaced' ELSE outcome END AS outcome, count(*) AS n FROM message_rows GROUP BY 1",
)
oracle(
    "params_clamped",
    """SELECT event_id, CASE WHEN isfinite(temperature) AND isfinite(top_p) THEN greatest(least(temperature, 0.6::DOUBLE), 0.01::DOUBLE) END AS temperature,
 CASE WHEN isfinite(temperature) AND isfinite(top_p) THEN greatest(least(top_p, 0.95::DOUBLE), 0.01::DOUBLE) END AS top_p,
 CAST(greatest(num_return_sequences, 1) AS BIGINT) AS num_return_sequences, isfinite(temperature) AND isfinite(top_p) AS valid FROM gen_params""",
)
oracle("params_regenerate", "SELECT event_id, greatest(least(temperature + 0.05::DOUBLE, 0.6::DOUBLE), 0.1::DOUBLE) AS temperature FROM gen_params")
oracle(
    "message_trailers",
    """SELECT o_orderkey AS commit_id, CASE WHEN issue_refs <> '' OR breaking_desc <> '' THEN concat(rtrim(m, concat(' ', chr(10))), chr(10), chr(10),
  CASE WHEN issue_refs <> '' THEN concat('Fixes: ', issue_refs, chr(10)) ELSE '' END, CASE WHEN breaking_desc <> '' THEN concat('BREAKING CHANGE: ', breaking_desc, chr(10)) ELSE '' END) ELSE m END AS message
 FROM (SELECT o_orderkey, concat('feat: ', o_orderpriority, ' ', chr(10)) AS m FROM orders) o JOIN trailers t ON t.commit_id = o.o_orderkey""",
)
oracle(
    "staleness_stream",
    """SELECT repo, count(*) FILTER (event_type = 'purchase' AND (last_build IS NULL OR (ts, event_id) > last_build)) AS behind,
 max(last_build) IS NULL OR count(*) FILTER (event_type = 'purchase' AND (last_build IS NULL OR (ts, event_id) > last_build)) > 5 AS stale FROM (
 SELECT *, max(CASE WHEN event_type = 'signup' THEN (ts, event_id) END) OVER (PARTITION BY repo) AS last_build FROM (
 SELECT event_id, ts, event_type, concat('repo_src', CAST(user_id % 20 AS VARCHAR)) AS repo FROM events WHERE event_type IN ('purchase', 'signup'))) GROUP BY repo""",
)


def _assemble() -> None:
    for name, text in _TEXTS.items():
        head = ", ".join(f"{v} AS ({_VIEWS[v].strip()})" for v in _closure(text))
        ORACLES[name] = (f"WITH {head} " if head else "") + text


_assemble()
