"""Change sets: counts, scopes, lookups in the knowledge base, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import paths as P
from sourceloom.functions import text as T
from sourceloom.operators import ordered as O
from sourceloom.operators.skew import salted_join

# Fixed value: a knowledge base is stale when more commits than this lie after its marker.
STALE_AFTER = 5


def change_count(paths: DataFrame) -> DataFrame:
    return paths.groupBy("commit_id").agg(F.count("*").alias("n_changed"))


def common_parts(low: Column, high: Column) -> Column:
    """Leading elements that two arrays share."""
    def first_difference(d: Column) -> Column:
        return F.slice(low, F.lit(1), F.coalesce(F.array_min(d) - 1, F.least(F.size(low), F.size(high))))

    differing = F.filter(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(low), F.size(high)), F.lit(1))),
        lambda i: ~F.coalesce(F.get(low, i - 1) == F.get(high, i - 1), F.lit(False)),
    )
    return T.let(differing, first_difference)


def commit_scope(paths: DataFrame) -> DataFrame:
    """Scope per commit: the file name of a single path, else the deepest shared directory.

    The shared prefix of a set of paths is that of its least and greatest member, so the
    aggregate needs two values per commit and never lists the paths.
    """
    parts = F.filter(F.split("path", "/"), lambda x: ~x.isin("", "."))
    found = paths.groupBy("commit_id").agg(
        F.count("*").alias("n"), F.min(parts).alias("low"), F.max(parts).alias("high"), F.max("path").alias("path")
    )
    shared = common_parts(F.col("low"), F.col("high"))
    return found.select(
        "commit_id",
        F.when(F.col("n") == 1, P.file_name(F.col("path")))
        .otherwise(F.coalesce(F.try_element_at(shared, F.lit(-1)), F.lit("")))
        .alias("scope"),
    )


def lookup_table(files: DataFrame, answers: DataFrame) -> DataFrame:
    """What a lookup of each file answers: ``(file_id, path, kb_file_id, ..)``.

    A path is answered by the survivor of its key, which may be another file. The join is
    at the grain of files, before any change is touched.
    """
    return _keyed(files).join(answers, ["repo", "kb_key"], "left").drop("kb_key")


def _keyed(files: DataFrame) -> DataFrame:
    return files.select("file_id", "repo", "path", P.without_extension(F.col("path")).alias("kb_key"))


def known_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``(file_id)`` of the files whose path is answered. ``keys``: ``(repo, kb_key)`` as ``kb.answered`` gives them."""
    return _keyed(files).join(keys, ["repo", "kb_key"], "left_semi").select("file_id")


def _path() -> Column:
    return F.coalesce("path", F.concat(F.lit("missing/p_"), F.col("file_id").cast("string")))


def with_paths(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes with the path of their file; a file that does not exist gets a made-up one."""
    return changes.join(files.select("file_id", "path"), "file_id", "left").withColumn("path", _path())


def change_context(changes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every change with what the knowledge base knows of its file, if anything."""
    return changes.join(lookup, "file_id", "left").withColumn("path", _path())


def unanalyzed(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Changes whose file the knowledge base does not know. ``known``: ``(file_id)`` as ``known_files`` gives them."""
    return changes.join(known, "file_id", "left_anti")


def snapshot_head(commits: DataFrame) -> DataFrame:
    """Newest commit per repository, as stored after a build; of equal times the greatest id."""
    time = F.coalesce(F.unix_micros(F.col("commit_ts").cast("timestamp")), F.lit(-(2**62)))  # before all times
    newest = O.joined_key(time, F.col("commit_id"))
    found = commits.groupBy("repo").agg(F.max(newest).alias("newest"), F.count("*").alias("n_commits"))
    return found.select("repo", O.low_part(F.col("newest")).alias("head_commit"), "n_commits")


def staleness(snapshots: DataFrame, commits: DataFrame, threshold: int = STALE_AFTER) -> DataFrame:
    """Per repository: commits after the marker and whether its knowledge base is stale.

    No marker or an unknown one means stale; a repository without commits is not stale.
    """
    place = F.struct("commit_ts", "commit_id")
    marked = commits.select("repo", F.col("commit_id").alias("stored_commit"), place.alias("marker"))
    markers = snapshots.join(marked, ["repo", "stored_commit"], "left").select("repo", "stored_commit", "marker")
    counted = (
        salted_join(commits.select("repo", "commit_id", "commit_ts"), markers.select("repo", "marker"), "repo", ["commit_id"])
        .groupBy("repo")
        .agg(F.count_if(place > F.col("marker")).alias("behind"), F.max(F.col("marker").isNotNull()).alias("known"))
    )
    return markers.join(counted, "repo", "left").select(
        "repo",
        F.when(F.col("known"), F.col("behind")).alias("behind"),
        F.when(F.col("known").isNull(), F.lit(False))
        .when(F.col("stored_commit").isNull() | ~F.col("known"), F.lit(True))
        .otherwise(F.col("behind") > threshold)
        .alias("stale"),
    )
