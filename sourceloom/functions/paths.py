"""Path and glob expressions. Paths are relative to their repository, with ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash, empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last extension of the file name, empty for names like ``.py``."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def without_extension(path: Column) -> Column:
    """Path minus its last extension; dots that lead a file name start none."""
    root = F.regexp_extract(path, r"^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", 1)
    return F.when(root != "", root).otherwise(path)


def ends_with_any(name: Column, endings: list[str]) -> Column:
    """Case-insensitive test of several endings at once."""
    return name.rlike("(?i)(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


_GLOB_TOKEN = r"\*|\?|\[!?\]?[^\]]*\]|[\s\S]"


def glob_regex(glob: Column, *, within_part: bool) -> Column:
    """Regular expression of a glob with ``*``, ``?``, ``[seq]`` and ``[!seq]``.

    With ``within_part`` nothing matches ``/``, else the wildcards cross it.
    """
    one = "[^/]" if within_part else "(?s:.)"
    barred = "/" if within_part else ""

    def token(t: Column) -> Column:
        body = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"([\[\]\\&^])", r"\\$1")
        negated = F.concat(F.lit("[^"), F.regexp_replace(body, "^!", ""), F.lit(f"{barred}]"))
        listed = F.concat(F.lit("["), body, F.lit("&&[^/]]" if within_part else "]"))
        return (
            F.when((t == "/") & F.lit(within_part), F.lit("(?!)"))
            .when(t == "*", F.lit(f"{one}*"))
            .when(t == "?", F.lit(one))
            .when((F.length(t) > 2) & t.startswith("[!"), negated)
            .when((F.length(t) > 2) & t.startswith("["), listed)
            .otherwise(F.regexp_replace(t, r"([\\.^$|()\[\]{}+*?&#-])", r"\\$1"))
        )

    return F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(_GLOB_TOKEN), F.lit(0)), token), "")
