"""Named queries over the given tables: one or more per operator of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom import fixtures
from sourceloom.functions import paths as P
from sourceloom.functions import text as T
from sourceloom.operators import changes as C
from sourceloom.operators import classify, completions, facts, ignore, prompts
from sourceloom.operators import kb as K
from sourceloom.operators.extract import javascript, julia
from sourceloom.operators.extract.analyze import analyze, unnest
from sourceloom.operators.extract.shapes import ARRAYS
from sourceloom.plans.workflows import KnowledgeBase, category_report, draft_prompts
from sourceloom.session import shared_dir, written
from sourceloom.sources import corpus
from sourceloom.sources.sinks import json_documents, write_json
from sourceloom.sources.tree import read_tree, write_files
from sourceloom.streaming import incremental, staleness

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fixtures.load(spark, sf, name)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.spread(_t(spark, sf, "source_files").select("file_id", "repo", "path", "content"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Source paths and page paths together."""
    return _files(spark, sf).select("file_id", "repo", "path").unionByName(_t(spark, sf, "page_paths"))


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.load_patterns(_t(spark, sf, "ignore_patterns"))


def _of(spark: SparkSession, sf: str, language: str) -> DataFrame:
    return corpus.with_language(_files(spark, sf)).where(F.col("language") == language)


def _kb(spark: SparkSession, sf: str, kinds: tuple[str, ...] = tuple(ARRAYS)) -> KnowledgeBase:
    return KnowledgeBase(_files(spark, sf), _patterns(spark, sf), kinds)


def _names(items: Column) -> Column:
    return F.array_join(items, ",")


# --- sources, sinks, filters -------------------------------------------------------


@query
def corpus_scan(spark, sf):
    files = _files(spark, sf)
    return files.select("file_id", "repo", "path", F.length("content").cast("bigint").alias("n_chars"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Source files as they lie in a raw tree: each below a directory of its own, every fifth with a dotted copy."""
    files = _t(spark, sf, "source_files").select("file_id", "repo", "path", "content")
    own = F.concat(F.lit("d"), F.col("file_id").cast("string"), F.lit("/"))
    dotted = files.where("file_id % 5 = 0").select(
        "repo", F.concat(own, P.directory(F.col("path")), F.lit("/."), P.file_name(F.col("path"))).alias("path"), "content"
    )
    return files.select("repo", F.concat(own, "path").alias("path"), "content").unionByName(dotted)


@query
def corpus_walk(spark, sf):
    """Files written as a raw tree, then scanned from there."""
    root = shared_dir(spark, "tree")
    rows = _tree(spark, sf).select(F.concat("repo", F.lit("/"), "path").alias("target"), "content")
    write_files(rows, root, "target", "content").write.format("noop").mode("overwrite").save()
    found = corpus.scan_corpus(spark, root)
    return found.select("repo", "path", F.length("content").cast("bigint").alias("n_chars"), F.coalesce("reason", F.lit("")).alias("reason"))


@query
def corpus_list(spark, sf):
    """Every file of the tree with what becomes of it; excluded directories as one row each."""
    root = shared_dir(spark, "tree")
    rows = _tree(spark, sf).select(F.concat("repo", F.lit("/"), "path").alias("target"), "content")
    write_files(rows, root, "target", "content").write.format("noop").mode("overwrite").save()
    return corpus.list_corpus(spark, root).select("repo", "path", F.coalesce("status", F.lit("")).alias("status"))


@query
def ignore_load(spark, sf):
    return _patterns(spark, sf).select(F.col("line_no").cast("bigint").alias("line_no"), "pattern")


@query
def language_map(spark, sf):
    return corpus.with_language(_paths(spark, sf)).select("file_id", "repo", "path", "language")


@query
def default_ignore(spark, sf):
    return _paths(spark, sf).where(ignore.default_ignored(F.col("path"))).select("file_id", "repo", "path")


@query
def ignore_match(spark, sf):
    return ignore.ignore_match(_paths(spark, sf), _patterns(spark, sf)).select("file_id", "repo", "path", "ignored")


@query
def ignore_filter(spark, sf):
    return ignore.ignore_filter(_paths(spark, sf), _patterns(spark, sf)).select("file_id", "repo", "path")


@query
def supported_files(spark, sf):
    return _paths(spark, sf).where(corpus.supported(F.col("path"))).select("file_id", "repo", "path")


@query
def unsupported_files(spark, sf):
    path = F.col("path")
    return _paths(spark, sf).where(~corpus.supported(path) & ~ignore.quiet(path)).select("file_id", "repo", "path")


@query
def change_paths(spark, sf):
    return corpus.change_paths(_t(spark, sf, "raw_changes"))


@query
def diff_nonempty(spark, sf):
    return corpus.nonempty_diffs(_t(spark, sf, "diffs"))


@query
def snapshot_head(spark, sf):
    return C.snapshot_head(_t(spark, sf, "commits"))


# --- Python ------------------------------------------------------------------------


def _imports(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "name", "source", _names(F.col("items")).alias("items"))


@query
def py_imports(spark, sf):
    return _imports(facts.facts_import(_of(spark, sf, "python"), ["python"]).where(F.col("items").isNull()))


@query
def py_from_imports(spark, sf):
    return _imports(facts.facts_import(_of(spark, sf, "python"), ["python"]).where(F.col("items").isNotNull()))


def _bases(bases: Column) -> Column:
    return _names(F.transform(bases, lambda b: F.concat_ws(" ", b["access"], b["name"])))


def _classes(spark, sf, language):
    return facts.facts_class(_of(spark, sf, language), [language]).select("file_id", "name", _bases(F.col("bases")).alias("bases"))


@query
def py_classes(spark, sf):
    both = analyze(_of(spark, sf, "python"), ["python"], ["classes", "enums"])
    row = lambda x, bases, is_enum: F.struct(x["name"].alias("name"), bases.alias("bases"), F.lit(is_enum).alias("is_enum"))
    listed = F.concat(
        F.transform("classes", lambda c: row(c, _bases(c["bases"]), False)),
        F.transform("enums", lambda e: row(e, F.lit(None).cast("string"), True)),
    )
    return unnest(both, ["file_id"], listed, "x").select("file_id", "x.*")


def _methods(spark, sf, language):
    return facts.facts_method(_of(spark, sf, language), [language]).select(
        "file_id", "class_name", "name", F.coalesce(F.size("parameters"), F.lit(0)).cast("bigint").alias("n_params")
    )


def _functions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "file_id", "name", "origin", _names(F.transform("parameters", lambda p: p["name"])).alias("params")
    )


def _params(spark, sf, language):
    return facts.facts_param(_of(spark, sf, language), [language]).select(
        "file_id", "owner", "callable", "param_position", "name", "type"
    )


def _docstrings(spark, sf, language):
    return facts.facts_docstring(_of(spark, sf, language), [language]).select("file_id", "kind", "name", "docstring")


def _variables(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "name", "kind", "type", "value")


def _attributes(spark, sf, language):
    return facts.facts_attribute(_of(spark, sf, language), [language]).select(
        "file_id", "class_name", "name", "type", "static"
    )


def _enums(spark, sf, language):
    return facts.facts_enum(_of(spark, sf, language), [language]).select(
        "file_id", "enum_name", "member_position", "member", "value"
    )


@query
def py_methods(spark, sf):
    return _methods(spark, sf, "python")


@query
def py_functions(spark, sf):
    return _functions(facts.facts_function(_of(spark, sf, "python"), ["python"]))


@query
def py_params(spark, sf):
    return _params(spark, sf, "python")


@query
def py_docstrings(spark, sf):
    return _docstrings(spark, sf, "python")


@query
def py_variables(spark, sf):
    return _variables(facts.facts_variable(_of(spark, sf, "python"), ["python"]))


@query
def py_attributes(spark, sf):
    return _attributes(spark, sf, "python")


@query
def py_enums(spark, sf):
    return _enums(spark, sf, "python")


# --- JavaScript --------------------------------------------------------------------


@query
def js_imports(spark, sf):
    rows = facts.facts_import(_of(spark, sf, "javascript"), ["javascript"])
    return _imports(rows.where(F.col("direction") == "import"))


@query
def js_exports(spark, sf):
    rows = facts.facts_import(_of(spark, sf, "javascript"), ["javascript"])
    return _imports(rows.where(F.col("direction") == "export"))


@query
def js_classes(spark, sf):
    return _classes(spark, sf, "javascript")


@query
def js_methods(spark, sf):
    return _methods(spark, sf, "javascript")


@query
def js_fields(spark, sf):
    return _attributes(spark, sf, "javascript")


@query
def js_functions(spark, sf):
    return _functions(facts.facts_function(_of(spark, sf, "javascript"), ["javascript"]))


@query
def js_params(spark, sf):
    return _params(spark, sf, "javascript")


@query
def js_variables(spark, sf):
    return _variables(facts.facts_variable(_of(spark, sf, "javascript"), ["javascript"]))


@query
def js_page_variables(spark, sf):
    """Variables of the inline scripts of web pages."""
    scripts = _t(spark, sf, "pages").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)))
    )
    lines = scripts.select("page_id", F.col("pos").cast("bigint").alias("script_no"), javascript.prepare(F.col("col")).alias("prepared"))
    return (
        lines.withColumn("items", javascript.items(F.col("prepared")))
        .select("page_id", "script_no", F.inline(javascript.variables(F.col("items"))))
        .select("page_id", "script_no", "name", "kind", "value")
    )


@query
def js_docstrings(spark, sf):
    return _docstrings(spark, sf, "javascript")


# --- C++ ---------------------------------------------------------------------------


@query
def cpp_includes(spark, sf):
    return _imports(facts.facts_import(_of(spark, sf, "cpp"), ["cpp"]))


@query
def cpp_classes(spark, sf):
    return _classes(spark, sf, "cpp")


@query
def cpp_bases(spark, sf):
    return facts.facts_base(_of(spark, sf, "cpp"), ["cpp"]).select(
        "file_id", "class_name", "base_position", "base", "access", "is_last"
    )


@query
def cpp_methods(spark, sf):
    return _methods(spark, sf, "cpp")


@query
def cpp_fields(spark, sf):
    return _attributes(spark, sf, "cpp")


@query
def cpp_functions(spark, sf):
    return _functions(facts.facts_function(_of(spark, sf, "cpp"), ["cpp"]))


@query
def cpp_params(spark, sf):
    return _params(spark, sf, "cpp")


@query
def cpp_variables(spark, sf):
    return _variables(facts.facts_variable(_of(spark, sf, "cpp"), ["cpp"]))


@query
def cpp_enums(spark, sf):
    return _enums(spark, sf, "cpp")


@query
def cpp_docstrings(spark, sf):
    return _docstrings(spark, sf, "cpp")


# --- Julia -------------------------------------------------------------------------


def _jl_functions(spark, sf) -> DataFrame:
    return _functions(facts.facts_function(_of(spark, sf, "julia"), ["julia"]))


@query
def jl_imports(spark, sf):
    return _imports(facts.facts_import(_of(spark, sf, "julia"), ["julia"]))


@query
def jl_functions(spark, sf):
    return _jl_functions(spark, sf).where(~F.col("name").startswith("@") & (F.col("origin") != "nested"))


@query
def jl_macros(spark, sf):
    return _jl_functions(spark, sf).where(F.col("name").startswith("@"))


@query
def jl_nested(spark, sf):
    return _jl_functions(spark, sf).where(F.col("origin") == "nested")


@query
def jl_structs(spark, sf):
    rows = facts.facts_class(_of(spark, sf, "julia"), ["julia"])
    return rows.select("file_id", "name", _bases(F.col("bases")).alias("bases"))


@query
def jl_fields(spark, sf):
    return _attributes(spark, sf, "julia")


@query
def jl_constructors(spark, sf):
    return _methods(spark, sf, "julia")


@query
def jl_variables(spark, sf):
    return _variables(facts.facts_variable(_of(spark, sf, "julia"), ["julia"]))


@query
def jl_params(spark, sf):
    return _params(spark, sf, "julia")


@query
def jl_docstrings(spark, sf):
    return _docstrings(spark, sf, "julia")


@query
def jl_modules(spark, sf):
    prepared = _of(spark, sf, "julia").withColumn("prepared", julia.prepare(F.col("content")))
    clean = prepared.withColumn("damage", julia.rejected(F.col("prepared")))
    items = F.when(F.col("damage").isNull(), julia.items(F.col("prepared")))
    return clean.withColumn("items", items).select("file_id", F.inline(julia.module_members(F.col("items"))))


@query
def triage(spark, sf):
    rows = _of(spark, sf, "julia").select("file_id", julia.triage(F.col("content")).alias("t"))
    return rows.select("file_id", "t.*")


def _fallback(files: DataFrame) -> DataFrame:
    def rows(kind: str) -> Column:
        names = julia.fallback_names(F.col("content"), kind)
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    return files.select("file_id", F.inline(F.concat(*[rows(k) for k in julia.FALLBACK])))


@query
def jl_regex_fallback(spark, sf):
    return _fallback(_of(spark, sf, "julia"))


@query
def jl_merge(spark, sf):
    """Facts of the full extraction plus the fallback ones it lacks, for every Julia file."""
    rows = _of(spark, sf, "julia")
    lines = analyze(rows, ["julia"]).where(~F.col("recovered"))
    primary = facts.union_facts(
        unnest(lines, ["file_id"], "functions", "x").select("file_id", F.lit("function").alias("kind"), "x.name"),
        unnest(lines, ["file_id"], "classes", "x").select("file_id", F.lit("struct").alias("kind"), "x.name"),
        unnest(lines, ["file_id"], "variables", "x").select("file_id", F.lit("constant").alias("kind"), "x.name"),
        unnest(lines, ["file_id"], "imports", "x").select("file_id", F.lit("import").alias("kind"), F.col("x.source").alias("name")),
    ).withColumn("origin", F.lit("primary"))
    kind = F.when(F.col("kind") == "macro", F.lit("function")).otherwise(F.col("kind"))
    fallback = _fallback(rows).withColumn("kind", kind).withColumn("origin", F.lit("fallback"))
    return facts.merge_facts(primary, fallback, ["file_id", "kind", "name"])


# --- classification and compaction -------------------------------------------------


def _imported(spark, sf) -> DataFrame:
    return analyze(corpus.with_language(_files(spark, sf)), kinds=["imports"])


@query
def import_roots(spark, sf):
    return unnest(_imported(spark, sf), ["file_id"], classify.import_roots(F.col("imports")), "root")


@query
def category_imports(spark, sf):
    category = classify.category_from_imports(classify.import_roots(F.col("imports")))
    return _imported(spark, sf).select("file_id", category.alias("category")).where(F.col("category").isNotNull())


@query
def category_path(spark, sf):
    return _paths(spark, sf).select("file_id", "repo", "path", classify.category_from_path(F.col("path")).alias("category"))


@query
def file_category(spark, sf):
    return _kb(spark, sf, ("imports",)).good.select("file_id", "repo", "path", "category")


@query
def category_counts(spark, sf):
    return category_report(_files(spark, sf), _patterns(spark, sf))


@query
def imports_compact(spark, sf):
    rows = unnest(_imported(spark, sf), ["file_id"], "imports", "i")
    return rows.select("file_id", K.compact_import(F.col("i")).alias("compact"))


@query
def variables_kept(spark, sf):
    rows = facts.facts_variable(corpus.with_language(_files(spark, sf)))
    return facts.variables_kept(rows).groupBy("language", "kind").agg(F.count("*").alias("n"))


@query
def params_kept(spark, sf):
    rows = facts.facts_param(corpus.with_language(_files(spark, sf)))
    return facts.params_kept(rows).groupBy("language", "name").agg(F.count("*").alias("n"))


@query
def all_facts(spark, sf):
    rows = facts.all_facts(corpus.with_language(_files(spark, sf)))
    return rows.groupBy("language", "kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


@query
def quarantine(spark, sf):
    _, failed = K.quarantine(K.build(_files(spark, sf).where(corpus.supported(F.col("path"))), ()))
    return failed.select("file_id", "repo", "path", "reason")


@query
def kb_json(spark, sf):
    return json_documents(_kb(spark, sf).built)


@query
def kb_compact(spark, sf):
    """What the compact documents hold, read back from their text."""
    docs = json_documents(_kb(spark, sf).built)

    def count(path: str) -> Column:
        return F.coalesce(F.json_array_length(F.get_json_object("kb_json", path)), F.lit(0)).cast("bigint")

    return docs.select(
        "repo",
        "json_path",
        count("$.imports").alias("n_imports"),
        count("$.classes").alias("n_classes"),
        count("$.functions").alias("n_functions"),
        count("$.variables").alias("n_variables"),
        F.get_json_object("kb_json", "$.category").alias("category"),
        F.get_json_object("kb_json", "$.enums").isNull().alias("no_enums"),
    )


@query
def kb_files(spark, sf):
    """One JSON file per path, read back from the tree they were written to."""
    root = shared_dir(spark, "kb")
    log = f"{shared_dir(spark, 'kb-log')}"
    write_json(_kb(spark, sf).built, root).write.parquet(log)
    found = read_tree(spark, root, [], 0, [".json"]).select(
        F.substring_index("path", "/", 1).alias("repo"),
        F.regexp_extract("path", "^[^/]*/(.*)$", 1).alias("json_path"),
        F.get_json_object(F.col("content").cast("string"), "$.path").alias("path"),
        F.coalesce(F.json_array_length(F.get_json_object(F.col("content").cast("string"), "$.functions")), F.lit(0)).cast("bigint").alias("n_functions"),
    )
    return spark.read.parquet(log).select("file_id", "repo", "json_path", "status").join(found, ["repo", "json_path"], "full")


@query
def kb_export(spark, sf):
    return K.export(_kb(spark, sf, ()).built).select("file_id", "repo", "path", "analyzed", "reason")


@query
def kb_collisions(spark, sf):
    return K.collisions(_kb(spark, sf, ()).good)


@query
def build_summary(spark, sf):
    return K.build_summary(K.status(_files(spark, sf), _patterns(spark, sf)))


# --- changes -----------------------------------------------------------------------


@query
def change_count(spark, sf):
    return C.change_count(corpus.change_paths(_t(spark, sf, "raw_changes")))


def _lookup(spark, sf) -> DataFrame:
    kb = _kb(spark, sf, ("imports",))
    rows = kb.good.select("file_id", "repo", "path", "category", F.col("path").alias("kb_path"))
    return C.lookup_table(kb.files, K.survivors(written(rows, "kb-categories"), ("category", "kb_path")))


def _changed(spark, sf) -> DataFrame:
    return C.change_context(_t(spark, sf, "changes"), _lookup(spark, sf))


@query
def change_context(spark, sf):
    return _changed(spark, sf).select("commit_id", "file_id", "path", "kb_path", "category")


@query
def unanalyzed_changes(spark, sf):
    kb = _kb(spark, sf, ())
    known = C.known_files(kb.files, K.answered(kb.good))
    return C.unanalyzed(_t(spark, sf, "changes"), known).select("commit_id", "file_id")


@query
def commit_scope(spark, sf):
    return C.commit_scope(C.with_paths(_t(spark, sf, "changes"), _files(spark, sf)))


@query
def kb_staleness(spark, sf):
    return C.staleness(_t(spark, sf, "kb_snapshots"), _t(spark, sf, "commits"))


def _contexts(spark, sf) -> DataFrame:
    changes = prompts.with_parts(_t(spark, sf, "changes"))
    kb = _kb(spark, sf, ("imports", "classes", "functions"))
    return C.change_context(changes, kb.lookup())


@query
def context_text(spark, sf):
    return prompts.context_text(_contexts(spark, sf))


@query
def prompt_render(spark, sf):
    diffs = corpus.nonempty_diffs(_t(spark, sf, "diffs"))
    kb = _kb(spark, sf, ("imports", "classes", "functions"))
    return draft_prompts(kb, _t(spark, sf, "changes"), diffs)


# --- completions -------------------------------------------------------------------


def _extracted(spark, sf) -> DataFrame:
    return completions.extract_json(_t(spark, sf, "completions"))


@query
def completion_json(spark, sf):
    return _extracted(spark, sf).select("conv_id", "turn", "json")


@query
def completion_parsed(spark, sf):
    return completions.parse_completion(_extracted(spark, sf)).select(
        "conv_id", "turn", "outcome", "attempt", "type", "scope", "description", "body"
    )


@query
def completion_retries(spark, sf):
    return completions.retry_queue(completions.parse_completion(_extracted(spark, sf))).select(
        "conv_id", "turn", "outcome", "attempt"
    )


@query
def completion_ledger(spark, sf):
    """Requests after all tries that have arrived."""
    found = completions.ledger(_t(spark, sf, "completions"), _t(spark, sf, "retry_answers"))
    return found.select("conv_id", "turn", "attempt", "outcome", "final", "type", "scope", "description", "body")


@query
def retry_messages(spark, sf):
    found = completions.retried_messages(_t(spark, sf, "completions"), _t(spark, sf, "retry_answers"))
    return found.select("conv_id", "turn", "attempt", "outcome", "commit_message")


@query
def retry_outcomes(spark, sf):
    return completions.outcomes(completions.retried_messages(_t(spark, sf, "completions"), _t(spark, sf, "retry_answers")))


@query
def type_normalised(spark, sf):
    return completions.normalise_type(completions.parse_completion(_extracted(spark, sf))).where(
        F.col("type").isNotNull()
    ).select("conv_id", "turn", "type", "invalid_type")


@query
def commit_message(spark, sf):
    return completions.messages(_t(spark, sf, "completions")).select("conv_id", "turn", "outcome", "commit_message")


@query
def completion_outcomes(spark, sf):
    return completions.outcomes(completions.messages(_t(spark, sf, "completions")))


@query
def params_clamped(spark, sf):
    return completions.clamp_params(_t(spark, sf, "gen_params")).select(
        "event_id", "temperature", "top_p", F.col("num_return_sequences").cast("bigint").alias("num_return_sequences"), "valid"
    )


@query
def params_regenerate(spark, sf):
    return completions.clamp_params(_t(spark, sf, "gen_params"), regenerate=True).select("event_id", "temperature")


@query
def message_trailers(spark, sf):
    texts = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("commit_id"), F.concat(F.lit("feat: "), F.col("o_orderpriority"), F.lit(" \n")).alias("message")
    )
    return completions.add_trailers(texts, _t(spark, sf, "trailers"))


# --- streaming ---------------------------------------------------------------------


@query
def kb_incremental(spark, sf):
    """Replays the corpus as file versions and returns the current rows."""
    source, table, state = (shared_dir(spark, n) for n in ("versions", "kb", "kb-stream"))
    files = _files(spark, sf)
    files.write.parquet(source)
    versions = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 4).parquet(source)
    incremental.start(versions, _patterns(spark, sf), table, state).awaitTermination()
    rows = incremental.newest(spark, table).where(F.col("failure").isNull())
    return rows.select("file_id", "repo", "path", "category", F.size("imports").cast("bigint").alias("n_imports"))


@query
def staleness_stream(spark, sf):
    """Replays the events in four slices of time, each run as new files from the last checkpoint."""
    source, table, state = (shared_dir(spark, n) for n in ("events", "staleness", "staleness-stream"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    seconds = F.col("ts").cast("timestamp").cast("double")
    cuts = events.select(seconds.alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01)
    slices = events.withColumn("_slice", sum(((seconds > c).cast("int") for c in cuts), F.lit(0)))
    for k in range(4):
        slices.where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        staleness.start(staleness.commit_events(stream), table, state).awaitTermination()
    return staleness.report(spark, table)
