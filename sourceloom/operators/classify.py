"""File category from imports, then from the path. All expressions, no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import paths as P
from sourceloom.functions import text as T

# Library names and the category they stand for, in rank order.
INDICATORS = [
    ("django", "web_framework"),
    ("flask", "web_framework"),
    ("react", "web_framework"),
    ("angular", "web_framework"),
    ("vue", "web_framework"),
    ("express", "web_framework"),
    ("pytest", "test"),
    ("unittest", "test"),
    ("jest", "test"),
    ("mocha", "test"),
    ("sqlalchemy", "database"),
    ("mongoose", "database"),
    ("sequelize", "database"),
    ("pandas", "data_processing"),
    ("numpy", "data_processing"),
    ("tensorflow", "ml"),
    ("torch", "ml"),
    ("sklearn", "ml"),
]

# Texts in the path and the category they stand for, in rank order.
PATH_RULES = [
    (("util", "helper", "lib"), "util"),
    (("test", "spec"), "test"),
    (("config", "conf"), "config"),
    (("setup",), "config"),
    (("model",), "model"),
    (("schema",), "model"),
    (("controller", "handler", "router", "route"), "controller"),
    (("service",), "service"),
    (("component",), "ui_component"),
    (("view",), "ui_component"),
]
ENTRY_POINTS = ["main.js", "index.js", "app.js", "server.js", "cli.js", "main.py", "cli.py"]


def import_roots(imports: Column) -> Column:
    """Distinct first name parts of the imported modules."""
    def roots(i: Column) -> Column:
        source = F.coalesce(i["source"], F.lit(""))
        name = F.coalesce(i["name"], F.lit(""))
        by_source = F.substring_index(F.substring_index(source, "/", 1), ".", 1)
        alone = (F.coalesce(F.size(i["items"]), F.lit(0)) <= 0) & ((name == source) | (source == ""))
        return F.array(by_source, F.when(alone, F.substring_index(name, ".", 1)).otherwise(F.lit("")))

    return F.filter(F.array_distinct(F.flatten(F.transform(imports, roots))), lambda r: r != "")


def category_from_imports(roots: Column) -> Column:
    """Category of the best-ranked indicator that occurs in any root, else NULL."""
    def ranked(text: Column) -> Column:
        out = F
        for indicator, category in INDICATORS:
            out = out.when(F.contains(text, F.lit(indicator)), F.lit(category))
        return out

    return T.let(F.lower(F.array_join(roots, "\n")), ranked)


def category_from_path(path: Column) -> Column:
    name = P.file_name(path)
    out = F
    for words, category in PATH_RULES:
        out = out.when(path.rlike("(?i)" + "|".join(words)), F.lit(category))
    return (
        out.when(name == "__init__.py", F.lit("package_init"))
        .when(name.isin(ENTRY_POINTS), F.lit("entrypoint"))
        .otherwise(F.lit("unknown"))
    )


def file_category(imports: Column, path: Column) -> Column:
    return F.coalesce(category_from_imports(import_roots(imports)), category_from_path(path))
