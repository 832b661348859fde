"""Filters, classification, changes, completions, prompts and sinks on small inputs."""

from __future__ import annotations

import fnmatch
import itertools
import json
import os.path
import random

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import paths as P
from sourceloom.operators import changes as C
from sourceloom.operators import classify, completions, facts, ignore, prompts
from sourceloom.operators import kb as K
from sourceloom.operators.extract import registry
from sourceloom.operators.skew import salted_join
from sourceloom.plans.workflows import KnowledgeBase, draft_prompts
from sourceloom.sources import corpus
from sourceloom.sources.sinks import json_documents, write_json, write_kb, write_snapshots, write_summary
from sourceloom.sources.tree import TreeReader, read_tree, write_files


def ignored_by_walk(path: str, patterns: list[str]) -> bool:
    """The rule as a pruned walk applies it: to every directory above, then to the file."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        above = "/".join(parts[:i])
        for p in patterns:
            if fnmatch.fnmatchcase(above, p):
                return True
            if any(fnmatch.fnmatchcase(part, p.rstrip("/")) for part in parts[:i]):
                return True
    return False


PATTERN_SETS = [
    ["build/"], ["*.log", "config.json"], ["temp*", "*cache*", "test*"], ["src/app"], ["src/*/x.py"], ["a?c"],
    ["[ab]*.py"], ["[!s]*/b.py"], ["x[.py"], ["a.b+c(d)"], [],
]


def test_ignore_rule_equals_a_pruned_walk(spark):
    names = ["src", "build", "app", "a.py", "x.py", "abc", "a.b+c(d)", "x[.py", "test_a", "mycache", "debug.log", "Src"]
    paths = ["/".join(c) for n in (1, 2, 3) for c in itertools.product(names, repeat=n)]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    for patterns in PATTERN_SETS:
        lines = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "line_no int, line string")
        got = ignore.ignore_match(files, corpus.load_patterns(lines)).where("ignored").select("path").collect()
        assert {r.path for r in got} == {p for p in paths if ignored_by_walk(p, patterns)}, patterns


def test_patterns_per_repository(spark):
    files = spark.createDataFrame([("a", "x/build/y"), ("b", "x/build/y"), ("c", "z")], "repo string, path string")
    patterns = spark.createDataFrame([("a", 1, "build/"), ("b", 1, "z")], "repo string, line_no int, line string")
    got = ignore.ignore_match(files, corpus.load_patterns(patterns)).collect()
    assert {(r.repo, r.ignored) for r in got} == {("a", True), ("b", False), ("c", False)}


def test_missing_ignore_file_gives_no_patterns(spark, tmp_path):
    assert corpus.read_patterns(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "list").write_text("# c\n\n build/ \n*.log\n")
    assert [r.pattern for r in corpus.read_patterns(spark, str(tmp_path / "list")).orderBy("line_no").collect()] == ["build/", "*.log"]


def test_path_parts(spark):
    cases = ["a/b.py", ".py", "a/.py", "x.tar.gz", "d.e/f", "..py", "a.", "main"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    for r in df.select("p", P.suffix(F.col("p")).alias("s"), P.without_extension(F.col("p")).alias("w")).collect():
        assert r.w == os.path.splitext(r.p)[0], r.p
    assert df.where(P.suffix(F.col("p")) == ".py").count() == 2


def test_categories(analysed, spark):
    r = analysed(
        ("utils/py_helper.py", "import os\n"), ("tests/test_x.py", "import pytest\n"),
        ("tests/a.spec.js", "import { it } from 'jest';\n"), ("core/__init__.py", ""), ("core/main.py", "x = 1\n"),
        ("core/net.js", "import express from '@scope/express-x';\nimport a from './react';\n"), ("core/a.py", "import torch.nn as nn\n"),
        ("core/b.cpp", '#include "react/x.h"\n'),
    )
    assert {k: v["category"] for k, v in r.items()} == {
        "utils/py_helper.py": "util", "tests/test_x.py": "test", "tests/a.spec.js": "test", "core/__init__.py": "package_init",
        "core/main.py": "entrypoint", "core/net.js": "unknown", "core/a.py": "ml", "core/b.cpp": "web_framework",
    }
    assert classify.INDICATORS[0] == ("django", "web_framework")


def test_scope_equals_the_common_path(spark):
    rng = random.Random(7)
    lists = [["file1.py"], ["dir/file1.py", "dir/file2.py"], ["/file1.py", "/file2.py"], ["a/b/c", "a/b/c"], ["a", "b"]]
    lists += [["/".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))] for _ in range(300)]
    rows = [(i, p) for i, ps in enumerate(lists) for p in ps]
    got = {r.commit_id: r.scope for r in C.commit_scope(spark.createDataFrame(rows, "commit_id long, path string")).collect()}
    for i, ps in enumerate(lists):
        want = os.path.basename(ps[0]) if len(ps) == 1 else os.path.basename(os.path.commonpath(ps))
        assert got[i] == ("" if want == "/" else want), ps


def test_staleness_cases(spark):
    commits = spark.createDataFrame([(f"{r}", n, n) for r in "abcd" for n in range(1, 11)], "repo string, commit_id long, commit_ts long")
    marks = spark.createDataFrame([("a", 10), ("b", 5), ("c", 4), ("d", 99), ("e", None)], "repo string, stored_commit long")
    got = {r.repo: (r.behind, r.stale) for r in C.staleness(marks, commits).collect()}
    assert got == {"a": (0, False), "b": (5, False), "c": (6, True), "d": (None, True), "e": (None, False)}


def test_salted_join_equals_a_plain_join(spark):
    large = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7)).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        assert sorted(map(str, salted_join(large, small, "k", ["id"], how).collect())) == sorted(map(str, large.join(small, "k", how).collect()))


COMPLETIONS = [
    ('```json\n{"type":"feat","scope":"api","description":"add new endpoint","body":"This is the body"}\n```', "parsed", "feat(api): add new endpoint\n\nThis is the body"),
    ('{"type":"fix","scope":null,"description":" trim ","body":"  "}', "parsed", "fix: trim"),
    ('text {"a":1} then {"type":"perf","description":"x"} end', "parsed", "feat: x"),
    ('{"type":"feat","description":""}', "blank description", None),
    ('{"type":5,"description":"x"}', "invalid record", None),
    ('{"type":"feat"}', "invalid record", None),
    ('{"type":"feat","description":"x","scope":3}', "invalid record", None),
    ("{not json}", "invalid record", None),
    ("nothing", "extraction failed", None),
    ('{"type": "feat", "desc', "extraction failed", None),
    (None, "extraction failed", None),
]


def test_completions(spark):
    rows = [(i, 0, c) for i, (c, _, _) in enumerate(COMPLETIONS)]
    df = completions.messages(spark.createDataFrame(rows, "conv_id long, turn long, completion string"))
    got = {r.conv_id: (r.outcome, r.commit_message) for r in df.collect()}
    assert got == {i: (o, m) for i, (_, o, m) in enumerate(COMPLETIONS)}
    parsed = completions.parse_completion(completions.extract_json(df.select("conv_id", "turn", "completion")))
    assert completions.retry_queue(parsed).count() == 7
    assert completions.retry_queue(parsed.withColumn("attempt", F.lit(1))).count() == 0


def test_ledger_joins_later_tries_until_each_request_is_final(spark):
    good = '{"type": "fix", "description": "done"}'
    first = [(1, 0, good), (2, 0, "none"), (3, 0, "none"), (4, 0, "none"), (5, 0, None), (6, 0, "none")]
    later = [
        (1, 0, 1, '{"type": "fix", "description": "late"}'),  # nobody waits for it
        (2, 0, 1, good), (2, 0, 1, good), (2, 0, 2, '{"type": "fix", "description": "later"}'),  # delivered twice
        (3, 0, 1, "none"), (3, 0, 2, good),
        (4, 0, 2, good),  # the first of its tries is still to come
        (6, 0, 1, "x"), (6, 0, 1, "y"), (6, 0, 2, "z"), (7, 0, 1, good),
    ]
    requests = spark.createDataFrame(first, "conv_id long, turn long, completion string")
    answers = spark.createDataFrame(later, "conv_id long, turn long, attempt long, completion string")

    def got(n):
        rows = completions.ledger(requests, answers, n).collect()
        assert len(rows) == 6
        return {r.conv_id: (r.attempt, r.outcome, r.final, r.description) for r in rows}

    none = "extraction failed"
    assert got(0) == {1: (0, "parsed", True, "done")} | {i: (0, none, True, None) for i in range(2, 7)}
    one = {1: (0, "parsed", True, "done"), 2: (1, "parsed", True, "done"), 3: (1, none, True, None)}
    assert got(1) == one | {4: (0, none, False, None), 5: (0, none, False, None), 6: (1, none, True, None)}
    two = one | {3: (2, "parsed", True, "done"), 4: (0, none, False, None), 5: (0, none, False, None)}
    assert got(2) == two | {6: (2, none, True, None)}
    plan = completions.ledger(requests, answers, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Python" not in plan
    assert completions.ledger(requests, answers.limit(0), 2).where("attempt > 0").count() == 0


def test_parameters(spark):
    rows = [(0.2, 0.95, 1), (5.0, 2.0, 0), (-1.0, -1.0, -3), (float("nan"), 0.5, 1), (float("inf"), 0.5, 1)]
    df = spark.createDataFrame(rows, "temperature double, top_p double, num_return_sequences int")
    got = [(r.temperature, r.top_p, r.num_return_sequences, r.valid) for r in completions.clamp_params(df).collect()]
    assert got == [(0.2, 0.95, 1, True), (0.6, 0.95, 1, True), (0.01, 0.01, 1, True), (None, None, 1, False), (None, None, 1, False)]
    again = [r.temperature for r in completions.clamp_params(df, regenerate=True).limit(3).collect()]
    assert again == pytest.approx([0.25, 0.6, 0.1])


@pytest.fixture(scope="module")
def small_kb(spark):
    files = [
        (1, "r", "src/a.py", 'import os\nclass A:\n    "Doc A."\n    def m(self, x):\n        return x\ndef f():\n    "Doc f."\n'),
        (2, "r", "src/a.js", "import fs from 'fs';\nlet x;\n"),
        (3, "r", "docs/n.md", "# n"),
        (4, "r", "src/b.py", "def broken(\n"),
        (5, "r", "node_modules/c.js", "const a = 1;"),
        (6, "r", "src/a.py", "import flask\nx: int = 3\n"),
        (7, "r", "build/d.py", "y = 1\n"),
        (8, "r", "src/e.rs", "fn"),
    ]
    df = spark.createDataFrame(files, "file_id long, repo string, path string, content string")
    patterns = corpus.load_patterns(spark.createDataFrame([(1, "build/")], "line_no int, line string"))
    return KnowledgeBase(df, patterns)


def test_every_file_has_one_status(small_kb):
    got = {r.file_id: r.status for r in K.status(small_kb.files, small_kb.patterns).collect()}
    assert got == {
        1: "analyzed", 2: "analyzed", 3: "not source", 4: "analysis failed", 5: "excluded directory",
        6: "analyzed", 7: "ignored by pattern", 8: "unsupported extension",
    }


def test_compact_documents(small_kb):
    docs = {(r.json_path, r.language): json.loads(r.kb_json) for r in json_documents(small_kb.built.where("file_id <> 6")).collect()}
    doc = docs["src/a.json", "python"]
    assert list(doc) == ["analyzer", "path", "imports", "classes", "functions"]
    assert doc["imports"] == ["os"]
    assert doc["classes"] == [{"name": "A", "docstring": "Doc A.", "methods": [{"name": "m", "parameters": [{"name": "x"}]}]}]
    assert doc["functions"] == [{"name": "f", "docstring": "Doc f."}]
    assert docs["src/a.json", "javascript"]["imports"] == [{"name": "fs", "source": "fs"}] or docs["src/a.json", "javascript"]["imports"] == ["fs"]
    assert "variables" not in docs["src/a.json", "javascript"]


def test_collisions_keep_the_greatest_path_and_newest_version(small_kb):
    got = [(r.kb_key, r.n_files, r.path, r.file_id) for r in K.collisions(small_kb.good).collect()]
    assert got == [("src/a", 3, "src/a.py", 6)]


def test_context_and_prompt(spark, small_kb):
    changes = spark.createDataFrame([(1, 1, 2), (1, 3, 1), (1, 4, 3), (1, -9, 4), (2, 2, 1)], "commit_id long, file_id long, seq int")
    diffs = spark.createDataFrame([(1, "+x", None), (2, "+y", None), (3, "+z", None), (4, None, "none")], "commit_id long, diff string, reason string")
    looked = C.change_context(prompts.with_parts(changes), small_kb.lookup())
    text = {r.commit_id: r.context for r in prompts.context_text(looked).collect()}
    block = "File 'src/a.py' (purpose: web_framework, imports: [flask]):\n"
    rest = "Files of this change without an analysis: [docs/n.md, src/b.py, missing/p_-9]\n"
    assert text == {1: prompts.BEGIN + block + rest + prompts.END, 2: prompts.BEGIN + block + prompts.END}
    out = {r.commit_id: r.prompt for r in draft_prompts(small_kb, changes, diffs.where("diff is not null")).collect()}
    assert set(out) == {1, 2, 3}
    assert text[1] in out[1] and "\n+x\n" in out[1]
    assert "Scope for the commit: general" in out[1] and "Scope for the commit: a.js" in out[2]
    assert prompts.BEGIN not in out[3]


def test_unanalyzed_changes_need_no_facts(spark, small_kb):
    known = C.known_files(small_kb.files, K.answered(small_kb.good))
    looked = {r.file_id for r in small_kb.lookup().where("kb_file_id is not null").collect()}
    assert {r.file_id for r in known.collect()} == looked and looked
    files = spark.createDataFrame([(1, "r", "a.py"), (None, "r", "b.py"), (3, None, "a.py"), (4, "r", "a.js")], "file_id long, repo string, path string")
    changes = spark.createDataFrame([(7, 1), (7, 3), (7, 4), (7, None), (8, 9)], "commit_id long, file_id long")
    rest = C.unanalyzed(changes, C.known_files(files, K.answered(files.where("path <> 'a.js'"))))
    assert sorted((r.commit_id, r.file_id or 0) for r in rest.collect()) == [(7, 0), (7, 3), (8, 9)]


def test_lookups_read_what_was_extracted_once(small_kb):
    plan = small_kb.lookup()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_large_commits_are_cut_into_whole_parts(spark):
    changes = spark.range(1000).select(F.lit(1).alias("commit_id"), F.col("id").alias("file_id"), F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id")).alias("path"))
    parts = prompts.with_parts(changes, part_files=100).withColumn("block", F.concat("path", F.lit("\n")))
    rows = prompts.context_text(parts).collect()
    assert len(rows) == 10
    listed = [x for r in rows for x in r.context.split("\n") if x.startswith("p")]
    assert sorted(listed) == sorted(f"p{i}" for i in range(1000))


def test_facts_and_merge(spark, small_kb):
    files = corpus.with_language(small_kb.files)
    assert {r.name for r in facts.params_kept(facts.facts_param(files, ["python"]).where("language = 'python'")).collect()} == {"x"}
    kept = facts.variables_kept(facts.facts_variable(files))
    assert {r.name for r in kept.collect()} == {"a", "y", "x"}
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    right = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert sorted(r.v for r in facts.merge_facts(left, right, ["k"]).collect()) == ["a", "c", "d"]


def test_scan_of_a_raw_tree_and_sinks(spark, tmp_path):
    root = tmp_path / "repos"
    for rel, text in {"one/src/a.py": "import os\n", "one/.git/b.py": "x", "two/c.jl": "using A\n", "two/d.txt": "t"}.items():
        f = root / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    files = corpus.scan_corpus(spark, str(root))
    assert {(r.repo, r.path, r.content) for r in files.collect()} == {("one", "src/a.py", "import os\n"), ("two", "c.jl", "using A\n")}
    built = K.build(files)
    write_kb(built, str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb")).count() == 2
    log = write_json(built, str(tmp_path / "json")).collect()
    assert {(r.repo, r.json_path, r.status) for r in log} == {("one", "src/a.json", "written"), ("two", "c.json", "written")}
    documents = {r.json_path: r.kb_json for r in json_documents(built).collect()}
    assert (tmp_path / "json/one/src/a.json").read_text() == documents["src/a.json"]
    assert sorted(p.name for p in (tmp_path / "json").rglob("*") if p.is_file()) == ["a.json", "c.json"]
    (tmp_path / "json2").mkdir()
    (tmp_path / "json2/one").write_text("a file where a directory should be")
    failed = {r.json_path: r.status for r in write_json(built, str(tmp_path / "json2")).collect()}
    assert failed == {"src/a.json": "write error", "c.json": "written"}
    clash = spark.createDataFrame([(1, "r", "x.js", "let a = 1;"), (2, "r", "x.py", "b = 2")], "file_id long, repo string, path string, content string")
    assert [(r.file_id, r.json_path) for r in write_json(K.build(clash), str(tmp_path / "json3")).collect()] == [(2, "x.json")]
    heads = spark.createDataFrame([("one", 5, 1)], "repo string, head_commit long, n_commits long")
    write_snapshots(heads, str(tmp_path / "marks"))
    assert spark.read.parquet(str(tmp_path / "marks")).first().stored_commit == 5


def test_a_language_can_be_added(spark):
    base = registry.LANGUAGES["python"]
    extra = registry.Language("mini", (".mini",), base.prepare, base.rejected, base.items, base.imports, base.classes, base.functions, base.variables, base.enums)
    registry.register(extra)
    try:
        df = spark.createDataFrame([(1, "r", "a.mini", "import os\n")], "file_id long, repo string, path string, content string")
        assert K.build(df).first()["imports"][0]["source"] == "os"
    finally:
        del registry.LANGUAGES["mini"]


def test_scan_keeps_every_file_in_one_table_or_the_other(spark, tmp_path):
    root = tmp_path / "src"
    files = {"one/src/b.py": b"import os\n", "one/a.PY": b"# caf\xe9\nimport sys\n", "two/node_modules/c.py": b"x", "two/d.md": b"text", "two/e.jl": b"using A\n"}
    for rel, data in files.items():
        f = root / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    rows = {(r.repo, r.path): r for r in corpus.scan_corpus(spark, str(root) + "/").collect()}
    assert set(rows) == {("one", "src/b.py"), ("one", "a.PY"), ("two", "e.jl")}
    assert rows["one", "a.PY"].reason == "not UTF-8" and rows["one", "a.PY"].content == "# caf\ufffd\nimport sys\n"
    assert rows["one", "src/b.py"].reason is None and rows["one", "src/b.py"].version > 0
    listed = {(r.repo, r.path): r.status for r in corpus.list_corpus(spark, str(root)).collect()}
    assert listed == {("one", "src/b.py"): None, ("one", "a.PY"): None, ("two", "e.jl"): None, ("two", "node_modules/"): "ignored", ("two", "d.md"): "unsupported"}


def test_walk_of_all_names_without_entering_excluded_directories(spark, tmp_path):
    root = tmp_path / "src"
    names = ["a/__init__.py", "a/_x/__main__.py", "a/.hid/.y.py", "a/node_modules/p/q.py", "a/x/.git/h.py", "node_modules/z.py", "a/x/deep/er/_f.jl", "b/.env", "c.py"]
    for rel in names:
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("x = 1\n")
    locked = root / "a/node_modules"
    locked.chmod(0)  # entering it would fail
    try:
        for shares in (1, 64):
            rows = {(r.path, r.kind) for r in read_tree(spark, str(root), ["node_modules", ".git"], 1, None, shares).collect()}
            assert rows == {(n, "file") for n in names if "/node_modules" not in n and "/.git/" not in n} | {("a/node_modules", "excluded"), ("a/x/.git", "excluded")}
        found = {(r.repo, r.path) for r in corpus.scan_corpus(spark, f"file://{root}").collect()}
    finally:
        locked.chmod(0o755)
    assert found == {("a", "__init__.py"), ("a", "_x/__main__.py"), ("a", ".hid/.y.py"), ("a", "x/deep/er/_f.jl"), ("node_modules", "z.py")}
    tree = TreeReader({"path": str(root), "excluded": "node_modules/.git", "repo_depth": "1", "shares": "2"})
    assert len(tree.partitions()) == 2
    with pytest.raises(Exception, match="no directory"):
        corpus.list_corpus(spark, str(tmp_path / "none")).collect()


def test_greatest_pairs_by_hash_aggregates(spark):
    edge = 2**63 - 1
    rows = [("r", "2024-01-01 00:00:00", 5), ("r", "2024-01-01 00:00:00", 9), ("r", "1960-05-05 00:00:00", edge), ("s", "1960-01-01 00:00:00", -edge - 1), ("t", None, 3)]
    commits = spark.createDataFrame(rows, "repo string, commit_ts string, commit_id long").withColumn("commit_ts", F.col("commit_ts").cast("timestamp"))
    assert {r.repo: (r.head_commit, r.n_commits) for r in C.snapshot_head(commits).collect()} == {"r": (9, 3), "s": (-edge - 1, 1), "t": (3, 1)}
    files = [(i, "r", p) for i, p in enumerate(["a.py", "a.js", "a.py", "b.PY", "b.py", "c.hpp", "c.hxx", "dir.x/d", "é.jl"])]
    files = spark.createDataFrame([*files, (-5, "q", "a.cpp"), (edge, "q", "a.cc")], "file_id long, repo string, path string")
    won = {(r.repo, r.kb_key): (r.kb_file_id, r.path) for r in K.survivors(files, ("path",)).collect()}
    assert won == {("r", "a"): (2, "a.py"), ("r", "b"): (4, "b.py"), ("r", "c"): (6, "c.hxx"), ("r", "dir.x/d"): (7, "dir.x/d"), ("r", "é"): (8, "é.jl"), ("q", "a"): (-5, "a.cpp")}
    clash = {(r.repo, r.kb_key): (r.n_files, r.path, r.file_id) for r in K.collisions(files).collect()}
    assert clash == {("r", "a"): (3, "a.py", 2), ("r", "b"): (2, "b.py", 4), ("r", "c"): (2, "c.hxx", 6), ("q", "a"): (2, "a.cpp", -5)}
    for df in (C.snapshot_head(commits), K.collisions(files), K.survivors(files, ("path",))):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_that_cannot_be_written_have_a_reason(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "x"), ("../c", "y"), (None, "z"), ("d", None)], "path string, text string")
    got = {r.path: (r.status, r.reason) for r in write_files(rows, str(tmp_path), "path", "text").collect()}
    assert got["a/b"] == ("written", None) and got["../c"][1] == "ValueError: path leaves the root"
    assert got[None][0] == got["d"][0] == "write error" and [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["b"]


def test_paths_outside_the_repository_are_ignored(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b.py", "../x.py", "/abs/x.py", "a/../../x.py", "a/..b/x.py", "..", "C:/x.py")], "path string")
    got = {r.path: r.ignored for r in ignore.ignore_match(files, spark.createDataFrame([("*.md",)], "pattern string")).collect()}
    assert got == {"a/b.py": False, "../x.py": True, "/abs/x.py": True, "a/../../x.py": True, "a/..b/x.py": False, "..": True, "C:/x.py": True}


def test_parts_follow_the_change_list(spark):
    changes = spark.range(2500).select(F.lit(1).alias("commit_id"), F.col("id").alias("seq"), F.col("id").alias("file_id"))
    rows = prompts.with_parts(changes).withColumns({"path": F.concat(F.lit("f"), "seq"), "block": F.concat(F.lit("f"), "seq", F.lit("\n"))})
    parts = prompts.context_text(rows).orderBy("part_no").collect()
    assert [r.part_no for r in parts] == [0, 1, 2]
    inner = "".join(r.context.removeprefix(prompts.BEGIN).removesuffix(prompts.END) for r in parts)
    assert inner == "".join(f"f{i}\n" for i in range(2500))


def test_extra_instructions_reach_the_prompt(spark, small_kb):
    changes = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "commit_id long, file_id long, seq int")
    diffs = spark.createDataFrame([(1, "+x"), (2, "+y")], "commit_id long, diff string")
    extra = spark.createDataFrame([(1, "Mention the ticket."), (2, "")], "commit_id long, additional_context string")
    out = {r.commit_id: r.prompt for r in draft_prompts(small_kb, changes, diffs, extra).collect()}
    assert "\n\nMention the ticket.\nScope for the commit:" in out[1] and "Mention" not in out[2]


def test_summary_is_written(spark, tmp_path):
    write_summary(spark.createDataFrame([("analyzed", 3)], "status string, n_files long"), str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "log")).select("status", "n_files").collect()] == [("analyzed", 3)]


def test_json_files_are_made_from_documents_made_once(spark, tmp_path):
    files = spark.createDataFrame([(1, "r", "x.js", "let a = 1;"), (2, "r", "x.py", "b = 2")], "file_id long, repo string, path string, content string")
    log = write_json(K.build(files), str(tmp_path / "json"))
    assert "damage" not in log._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.file_id, r.status) for r in log.collect()] == [(2, "written")]
