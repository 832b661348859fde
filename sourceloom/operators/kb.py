"""The knowledge base: one row per file, its compact JSON form, and its by-products."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import paths as P
from sourceloom.functions import text as T
from sourceloom.operators import classify
from sourceloom.operators import ordered as O
from sourceloom.operators.extract.analyze import analyze
from sourceloom.operators.extract.registry import LANGUAGES, extension_rows
from sourceloom.operators.extract.shapes import ARRAYS
from sourceloom.operators.ignore import default_ignored, ignore_match, quiet
from sourceloom.sources.corpus import language_of, supported, with_language

# Bytes of an extension that fit beside an id in one number.
RANKED_BYTES = 7


def sift(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``language`` and ``skipped``: why a file is not analysed, NULL if it is.

    Decided on the path alone, so the content of skipped files is never looked at.
    """
    marked = ignore_match(files, patterns)
    path = F.col("path")
    skipped = (
        F.when(default_ignored(path), F.lit("excluded directory"))
        .when(F.col("ignored"), F.lit("ignored by pattern"))
        .when(~supported(path), F.when(quiet(path), F.lit("not source")).otherwise(F.lit("unsupported extension")))
    )
    return marked.select(*files.columns, language_of(path).alias("language"), skipped.alias("skipped"))


def candidates(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """The files to analyse, with their language."""
    return sift(files, patterns).where(F.col("skipped").isNull()).drop("skipped")


def build(files: DataFrame, kinds: Iterable[str] = tuple(ARRAYS)) -> DataFrame:
    """Analyse files: arrays, ``analyzer``, ``failure`` and, if imports are asked for, ``category``.

    Map-only. Naming the arrays a job needs keeps its plan small.
    """
    known = files if "language" in files.columns else with_language(files)
    names = [F.lit(v) for g in LANGUAGES.values() for v in (g.name, g.analyzer)]
    rows = analyze(known, kinds=kinds).withColumn(
        "analyzer", F.coalesce(F.try_element_at(F.create_map(*names), F.col("language")), F.lit("unknown"))
    )
    if "imports" not in kinds:
        return rows
    return rows.withColumn("category", classify.file_category(F.col("imports"), F.col("path")))


def quarantine(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures of one plan."""
    failed = built.where(F.col("failure").isNotNull())
    return (
        built.where(F.col("failure").isNull()).drop("failure"),
        failed.select("file_id", "repo", "path", "analyzer", F.col("failure").alias("reason")),
    )


def export(built: DataFrame) -> DataFrame:
    """Success and failure records in one table, keyed by repository and path."""
    return built.select(
        "file_id", "repo", "path", "analyzer", F.col("failure").isNull().alias("analyzed"), F.col("failure").alias("reason")
    )


def status(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per file with what became of it; every file has exactly one status."""
    sifted = sift(files, patterns).withColumn("content", F.when(F.col("skipped").isNull(), F.col("content")))
    outcome = F.coalesce(
        F.col("skipped"),
        F.when(F.col("failure").isNotNull(), F.lit("analysis failed")).otherwise(F.lit("analyzed")),
    )
    return analyze(sifted, kinds=()).select("file_id", "repo", "path", outcome.alias("status"))


def build_summary(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("repo", "status").agg(F.count("*").alias("n_files"))


def _key(path: Column) -> Column:
    return P.without_extension(path)


def _winners(rows: DataFrame) -> DataFrame:
    """``(repo, kb_key, n_files, path, file_id)`` per path up to the extension: the greatest path, its greatest ``file_id``.

    Paths of one key differ in their extension only, so extension and id make a number that is ordered as they are. Numbers are
    aggregated in place, by hash and before the shuffle, which strings and structs are not. Extensions of more than
    seven bytes, if a registered language has any, are compared as they are.
    """
    keyed = rows.select("repo", "path", "file_id", _key(F.col("path")).alias("kb_key"))
    keyed = keyed.withColumn("suffix", F.substr("path", F.length("kb_key") + 1))
    if max(len(e.encode()) for e, _ in extension_rows()) > RANKED_BYTES:
        best = keyed.groupBy("repo", "kb_key").agg(F.count("*").alias("n_files"), F.max(F.struct("suffix", "file_id")).alias("kept"))
        return best.select("repo", "kb_key", "n_files", F.concat("kb_key", "kept.suffix").alias("path"), F.col("kept.file_id").alias("file_id"))
    hexed = F.rpad(F.hex(F.encode("suffix", "utf-8")), 2 * RANKED_BYTES, "0")
    ranked = keyed.select("repo", "kb_key", O.joined_key(F.conv(hexed, 16, 10).cast("bigint"), F.col("file_id")).alias("rank"))
    best = ranked.groupBy("repo", "kb_key").agg(F.count("*").alias("n_files"), F.max("rank").alias("rank"))
    shown = F.rtrim(F.decode(F.unhex(F.lpad(F.conv(O.high_part(F.col("rank")).cast("string"), 10, 16), 2 * RANKED_BYTES, "0")), "utf-8"), F.lit("\0"))
    return best.select("repo", "kb_key", "n_files", F.concat("kb_key", shown).alias("path"), O.low_part(F.col("rank")).alias("file_id"))


def collisions(built: DataFrame) -> DataFrame:
    """Files that share a path up to the extension, and the one that is kept: the greatest path, its newest version first."""
    return _winners(built).where("n_files > 1")


def survivors(rows: DataFrame, attach: tuple[str, ...] = ()) -> DataFrame:
    """``(repo, kb_key, kb_file_id, ..)``: the file that answers a lookup, with columns of it.

    The winners are found on paths and ids alone; wide columns are looked up for them by id.
    """
    best = _winners(rows).select("repo", "kb_key", F.col("file_id").alias("kb_file_id"), F.col("path").alias("_path"))
    if not attach:
        return best.drop("_path")
    others = [c for c in attach if c != "path"]
    wide = rows.select(F.col("repo").alias("_repo"), F.col("path").alias("_own"), F.col("file_id").alias("_id"), *others)
    same = (F.col("_id") == F.col("kb_file_id")) & (F.col("_own") == F.col("_path")) & (F.col("_repo") == F.col("repo"))
    return best.join(wide, same).select("repo", "kb_key", "kb_file_id", *[F.col("_path").alias("path") if c == "path" else c for c in attach])


def answered(rows: DataFrame) -> DataFrame:
    """``(repo, kb_key)``: the keys that some file answers. Which one does not matter, so nothing is ranked or looked up."""
    keys = rows.where(F.col("file_id").isNotNull()).select("repo", _key(F.col("path")).alias("kb_key"))
    return keys.distinct()


def compact_import(i: Column) -> Column:
    """JSON of one import: the bare name if name and source agree and nothing is picked."""
    bare = F.coalesce(i["name"] == i["source"], F.lit(False)) & (F.coalesce(F.size(i["items"]), F.lit(0)) <= 0)
    text = F.to_json(F.array(i["name"]))
    full = F.to_json(
        F.struct(
            i["name"].alias("name"),
            F.when(~F.coalesce(i["name"] == i["source"], F.lit(False)), i["source"]).alias("source"),
            i["items"].alias("items"),
        )
    )
    return F.when(bare, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(full)


def _method(m: Column) -> Column:
    kept = F.filter(m["parameters"], lambda p: p["name"] != "self")
    return F.struct(
        m["name"].alias("name"),
        T.no_empty(m["docstring"]).alias("docstring"),
        T.empty_to_null(kept).alias("parameters"),
    )


def _class(c: Column) -> Column:
    return F.struct(
        c["name"].alias("name"),
        T.no_empty(c["docstring"]).alias("docstring"),
        c["bases"].alias("bases"),
        F.transform(c["methods"], _method).alias("methods"),
    )


def _variables(variables: Column) -> Column:
    return F.filter(
        variables, lambda v: (F.coalesce(v["value"], F.lit("")) != "") | (v["kind"] != "external_variable")
    )


def compact(built: DataFrame) -> DataFrame:
    """Adds ``kb_json``: no empty field, no attributes, no enums, no ``self``, no category ``unknown``."""
    def field(name: str, json: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), json)

    def listed(items: Column) -> Column:
        return F.when(F.size(items) > 0, F.to_json(items))

    def text(value: Column) -> Column:
        json = F.to_json(F.array(value))
        return F.substring(json, F.lit(2), F.length(json) - 2)

    imports = F.when(
        F.size("imports") > 0,
        F.concat(F.lit("["), F.array_join(F.transform("imports", compact_import), ","), F.lit("]")),
    )
    fields = [
        field("analyzer", text(F.col("analyzer"))),
        field("path", text(F.col("path"))),
        field("imports", imports),
        field("classes", listed(F.transform("classes", _class))),
        field("functions", listed(F.transform("functions", _method))),
        field("variables", listed(_variables(F.col("variables")))),
        field("category", F.when(F.col("category") != "unknown", text(F.col("category")))),
    ]
    return built.withColumn("kb_json", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
