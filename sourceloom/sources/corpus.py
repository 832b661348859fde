"""Corpus, ignore-list, change-list and diff sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import paths as P
from sourceloom.functions import text as T
from sourceloom.operators.extract.registry import extension_rows
from sourceloom.operators.ignore import DEFAULT_DIRECTORIES
from sourceloom.sources.tree import read_tree


def _placed(rows: DataFrame, repo_depth: int) -> DataFrame:
    """Splits paths below the root into repository and path."""
    level = "/".join(["[^/]+"] * repo_depth)
    found = rows.withColumns({"repo": F.regexp_extract("path", f"^({level})/", 1), "path": F.regexp_extract("path", f"^{level}/(.*)$", 1)})
    return found.where(F.col("path") != "")


def list_corpus(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Every file under ``root``: ``(file_id, repo, path, version, status)``; no content is read.

    The first ``repo_depth`` directories below the root name the repository. ``version`` is the time of the last change in
    microseconds. ``status`` says why a file is passed over, and is NULL for those to be read. A directory that is never
    entered has one row with its path and a slash; nothing below it is listed.
    """
    rows = _placed(read_tree(spark, root, DEFAULT_DIRECTORIES, repo_depth), repo_depth)
    path = F.when(F.col("kind") == "excluded", F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    status = F.when(F.col("kind") == "excluded", F.lit("ignored")).when(~supported(F.col("path")), F.lit("unsupported"))
    return rows.select(F.xxhash64("repo", path).alias("file_id"), "repo", path.alias("path"), "version", status.alias("status"))


def scan_corpus(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Raw trees under ``root``: ``(file_id, repo, path, content, version, reason)`` of the files to be analysed.

    Only files with a supported extension are opened, whatever their names begin with; the directories that are always excluded
    are never entered. A byte that is no UTF-8 becomes the replacement character, and ``reason`` says so; a file that
    cannot be read has no content and a ``reason``. ``list_corpus`` has a row for every other file.
    """
    endings = [e for e, _ in extension_rows()]
    rows = _placed(read_tree(spark, root, DEFAULT_DIRECTORIES, repo_depth, endings).where(F.col("kind") == "file"), repo_depth)
    text = F.col("content").cast("string")
    return rows.select(
        F.xxhash64("repo", "path").alias("file_id"),
        "repo",
        "path",
        F.make_valid_utf8(text).alias("content"),
        "version",
        F.coalesce("error", F.when(~F.is_valid_utf8(text), F.lit("not UTF-8"))).alias("reason"),
    )


def spread(files: DataFrame) -> DataFrame:
    """Split a small input over all cores; an input with enough splits stays as it is.

    Extraction is bound by processing, so a few large splits would leave cores idle.
    ``file_id`` is unique, hence the parts are even and the same after a recomputation.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    if files.rdd.getNumPartitions() >= cores:
        return files
    return files.repartition(cores, "file_id")


def load_patterns(lines: DataFrame) -> DataFrame:
    """Ignore-list lines without blanks and comments, stripped; order is ``line_no``."""
    stripped = lines.withColumn("pattern", T.strip(F.col("line"))).drop("line")
    return stripped.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of an ignore file; a missing file gives none."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    return load_patterns(lines.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")))


def language_of(path: Column) -> Column:
    """Language by lower-cased suffix, NULL when there is none."""
    pairs = [F.lit(v) for row in extension_rows() for v in row]
    return F.try_element_at(F.create_map(*pairs), F.lower(P.suffix(path)))


def supported(path: Column) -> Column:
    """Does the file name end in a supported extension? ``.py`` as a whole name does."""
    return P.ends_with_any(P.file_name(path), [ext for ext, _ in extension_rows()])


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def languages(spark: SparkSession) -> DataFrame:
    """The extension dimension as a table."""
    return spark.createDataFrame(extension_rows(), "extension string, language string")


def change_paths(raw: DataFrame) -> DataFrame:
    """One row per path of a newline-separated change list, stripped, blanks dropped."""
    return (
        raw.select("commit_id", F.posexplode(F.split("stdout", "\n")).alias("at", "line"))
        .select("commit_id", F.col("at").cast("bigint").alias("seq"), T.strip(F.col("line")).alias("path"))
        .where(F.col("path") != "")
    )


def nonempty_diffs(diffs: DataFrame) -> DataFrame:
    """Diffs with a ``reason`` where there is nothing to do: blank text gives no diff."""
    blank = F.col("diff").isNull() | (T.strip(F.col("diff")) == "")
    return diffs.select(
        "commit_id",
        F.when(~blank, F.col("diff")).alias("diff"),
        F.when(blank, F.lit("no staged changes")).alias("reason"),
    )
