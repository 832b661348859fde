"""Which files are left out: fixed directories, ignore patterns, extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import paths as P
from sourceloom.operators.skew import salted_join

# Directories that are never entered. The last one is our own output folder.
DEFAULT_DIRECTORIES = [".git", ".hg", ".svn", ".vscode", "node_modules", "__pycache__", ".sourceloom"]

# Extensions that are passed over without a report.
QUIET_EXTENSIONS = [
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".json", ".md", ".txt", ".log", ".gz", ".zip", ".tar",
]


def default_ignored(path: Column) -> Column:
    """Does the file lie under an excluded directory? The file name itself does not count."""
    names = "|".join(d.replace(".", r"\.") for d in DEFAULT_DIRECTORIES)
    return path.rlike(f"(?:^|/)(?:{names})/")


def outside(path: Column) -> Column:
    """Does the path leave its repository? Absolute paths do, and those with more steps up than down."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, x: F.struct(
            (a["now"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("now"),
            F.least(a["least"], a["now"] + F.when(x == "..", -1).otherwise(0)).alias("least"),
        ),
    )
    # the running sum is only needed where a path has a step up at all
    climbs = F.when(path.contains(".."), depth["least"] < 0).otherwise(F.lit(False))
    return F.coalesce(path.startswith("/") | path.rlike("^[A-Za-z]:[/\\\\]") | climbs, F.lit(False))


def quiet(path: Column) -> Column:
    name = P.file_name(path)
    return P.ends_with_any(name, QUIET_EXTENSIONS) | name.startswith(".")


def pattern_regex(pattern: Column) -> Column:
    """One regular expression, to be searched in a path, for a whole ignore pattern.

    The first branch matches the path or any directory above it as a whole; the second
    one any single part, for which trailing slashes of the pattern do not count.
    """
    bare = F.regexp_replace(pattern, "/+$", "")
    whole = F.concat(F.lit("^(?:"), P.glob_regex(pattern, within_part=False), F.lit(")(?:/|$)"))
    part = F.concat(F.lit("(?:^|/)(?:"), P.glob_regex(bare, within_part=True), F.lit(")(?:/|$)"))
    return F.concat(whole, F.lit("|"), part)


def rules(patterns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All patterns of one ignore list as one expression, so that a path is tested once."""
    one = F.concat(F.lit("(?:"), pattern_regex(F.col("pattern")), F.lit(")"))
    return patterns.groupBy(*(by or [])).agg(F.array_join(F.array_sort(F.collect_set(one)), "|").alias("rule"))


def ignore_match(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``ignored``. Patterns with a ``repo`` column apply to that repository only.

    A list without repositories is one small configuration file and becomes a scalar of
    the plan: files are neither shuffled nor compared pattern by pattern. Lists per
    repository are joined by repository, spread over salts.
    """
    def test(rule: Column) -> Column:
        # counting keeps the compiled rule from row to row, which a plain test of a rule column does not
        return outside(F.col("path")) | F.coalesce((rule != "") & (F.regexp_count("path", rule) > 0), F.lit(False))

    if "repo" in patterns.columns:
        joined = salted_join(files, rules(patterns, ["repo"]), "repo", ["path"], "left")
        return joined.withColumn("ignored", test(F.col("rule"))).drop("rule")
    return files.withColumn("ignored", test(rules(patterns).scalar()))


def ignore_filter(files: DataFrame, patterns: DataFrame) -> DataFrame:
    return ignore_match(files, patterns).where(~F.col("ignored")).drop("ignored")
