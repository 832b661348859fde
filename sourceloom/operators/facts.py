"""Flat fact tables: one row per import, class, method, parameter and so on.

All are map-only: the arrays of ``analyze`` are unnested where they were built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.extract.analyze import analyze, unnest

KEYS = ["file_id", "repo", "path", "language"]


def _rows(files: DataFrame, kind: str, languages=None) -> DataFrame:
    """One row per element of one array."""
    return unnest(analyze(files, languages, [kind]), KEYS, kind, "x", "position")


def _joined(names: Column) -> Column:
    return F.array_join(names, ",")


def facts_import(files: DataFrame, languages=None) -> DataFrame:
    return _rows(files, "imports", languages).select(*KEYS, "position", "x.*")


def facts_class(files: DataFrame, languages=None) -> DataFrame:
    return _rows(files, "classes", languages).select(
        *KEYS,
        F.col("x.name").alias("name"),
        F.col("x.bases").alias("bases"),
        F.col("x.docstring").alias("docstring"),
    )


def facts_base(files: DataFrame, languages=None) -> DataFrame:
    """One row per base class; ``is_last`` marks the last one of its class."""
    classes = _rows(files, "classes", languages).select(
        *KEYS, F.col("x.name").alias("class_name"), F.size("x.bases").alias("n"), F.col("x.bases").alias("bases")
    )
    return (
        unnest(classes, [*KEYS, "class_name", "n"], "bases", "b", "at")
        .select(
            *KEYS,
            "class_name",
            F.col("at").cast("bigint").alias("base_position"),
            F.col("b.name").alias("base"),
            F.col("b.access").alias("access"),
            (F.col("at") == F.col("n") - 1).alias("is_last"),
        )
    )


def _members(files: DataFrame, field: str, languages=None) -> DataFrame:
    classes = _rows(files, "classes", languages).select(
        *KEYS, F.col("x.name").alias("class_name"), F.col(f"x.{field}").alias(field)
    )
    return unnest(classes, [*KEYS, "class_name"], field, "m").select(*KEYS, "class_name", "m.*")


def facts_method(files: DataFrame, languages=None) -> DataFrame:
    return _members(files, "methods", languages)


def facts_attribute(files: DataFrame, languages=None) -> DataFrame:
    return _members(files, "attributes", languages)


def facts_function(files: DataFrame, languages=None) -> DataFrame:
    return _rows(files, "functions", languages).select(*KEYS, "x.*")


def facts_variable(files: DataFrame, languages=None) -> DataFrame:
    return _rows(files, "variables", languages).select(*KEYS, "x.*")


def facts_enum(files: DataFrame, languages=None) -> DataFrame:
    """One row per enum member, in order; an empty enum gives one row without member."""
    return (
        _rows(files, "enums", languages)
        .select(
            *KEYS,
            F.col("x.name").alias("enum_name"),
            F.col("x.docstring").alias("docstring"),
            F.posexplode_outer("x.members").alias("at", "m"),
        )
        .select(
            *KEYS,
            "enum_name",
            "docstring",
            F.col("at").cast("bigint").alias("member_position"),
            F.col("m.name").alias("member"),
            F.col("m.value").alias("value"),
        )
    )


def _callables(files: DataFrame, languages=None) -> DataFrame:
    """Functions and methods in one pass: owner is the class or NULL."""
    both = analyze(files, languages, ["classes", "functions"])
    methods = F.flatten(
        F.transform(
            "classes",
            lambda c: F.transform(
                F.coalesce(c["methods"], F.array()),
                lambda m: F.struct(
                    F.lit("method").alias("kind"),
                    c["name"].alias("owner"),
                    m["name"].alias("name"),
                    m["parameters"].alias("parameters"),
                    m["docstring"].alias("docstring"),
                ),
            ),
        )
    )
    functions = F.transform(
        "functions",
        lambda f: F.struct(
            F.lit("function").alias("kind"),
            F.lit(None).cast("string").alias("owner"),
            f["name"].alias("name"),
            f["parameters"].alias("parameters"),
            f["docstring"].alias("docstring"),
        ),
    )
    return unnest(both, KEYS, F.concat(functions, methods), "c").select(*KEYS, "c.*")


def facts_param(files: DataFrame, languages=None) -> DataFrame:
    return (
        unnest(_callables(files, languages), [*KEYS, "owner", "name"], "parameters", "p", "at")
        .select(
            *KEYS,
            "owner",
            F.col("name").alias("callable"),
            F.col("at").cast("bigint").alias("param_position"),
            F.col("p.name").alias("name"),
            F.col("p.type").alias("type"),
        )
    )


def facts_docstring(files: DataFrame, languages=None) -> DataFrame:
    """One row per documented class, enum, method and function."""
    every = analyze(files, languages, ["classes", "functions", "enums"])

    def entry(kind: str, owner: Column, x: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), owner.alias("owner"), x["name"].alias("name"), x["docstring"].alias("docstring")
        )

    nobody = F.lit(None).cast("string")
    listed = F.concat(
        F.transform("classes", lambda c: entry("class", nobody, c)),
        F.transform("enums", lambda e: entry("enum", nobody, e)),
        F.transform("functions", lambda f: entry("function", nobody, f)),
        F.flatten(
            F.transform(
                "classes",
                lambda c: F.transform(F.coalesce(c["methods"], F.array()), lambda m: entry("method", c["name"], m)),
            )
        ),
    )
    return unnest(every, KEYS, F.filter(listed, lambda x: x["docstring"].isNotNull()), "d").select(*KEYS, "d.*")


def params_kept(params: DataFrame) -> DataFrame:
    """Parameters without the ones named ``self``."""
    return params.where(F.col("name") != "self")


def variables_kept(variables: DataFrame) -> DataFrame:
    """Variables with a value, or of a kind other than external."""
    return variables.where((F.coalesce(F.col("value"), F.lit("")) != "") | (F.col("kind") != "external_variable"))


def all_facts(files: DataFrame, languages=None) -> DataFrame:
    """Every named element of a file as ``(kind, owner, name)``, built in one pass over the files."""
    every = analyze(files, languages)

    def entry(kind: Column, owner: Column, name: Column) -> Column:
        return F.struct(kind.alias("kind"), owner.alias("owner"), name.alias("name"))

    nobody = F.lit(None).cast("string")

    def members(array: str, field: str, kind: str) -> Column:
        return F.flatten(
            F.transform(
                array,
                lambda c: F.transform(
                    F.coalesce(c[field], F.array()), lambda m: entry(F.lit(kind), c["name"], m["name"])
                ),
            )
        )

    listed = F.concat(
        F.transform("imports", lambda i: entry(i["direction"], nobody, i["source"])),
        F.transform("classes", lambda c: entry(F.lit("class"), nobody, c["name"])),
        members("classes", "methods", "method"),
        members("classes", "attributes", "attribute"),
        F.transform("functions", lambda f: entry(F.lit("function"), nobody, f["name"])),
        F.transform("variables", lambda v: entry(v["kind"], nobody, v["name"])),
        F.transform("enums", lambda e: entry(F.lit("enum"), nobody, e["name"])),
    )
    return unnest(every, KEYS, listed, "x").select(*KEYS, "x.*")


def union_facts(*tables: DataFrame) -> DataFrame:
    """Bag union of fact tables by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_facts(primary: DataFrame, fallback: DataFrame, key: list[str]) -> DataFrame:
    """Primary rows, then fallback rows whose key the primary table does not hold."""
    return primary.unionByName(fallback.join(primary.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
