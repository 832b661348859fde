"""Element types of the knowledge-base arrays and builders for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMPORT = "struct<name:string,source:string,items:array<string>,direction:string>"
PARAMETER = "struct<name:string,type:string>"
BASE = "struct<name:string,access:string>"
METHOD = f"struct<name:string,parameters:array<{PARAMETER}>,docstring:string>"
ATTRIBUTE = "struct<name:string,type:string,static:boolean,docstring:string>"
CLASS = (
    f"struct<name:string,bases:array<{BASE}>,methods:array<{METHOD}>,attributes:array<{ATTRIBUTE}>,docstring:string>"
)
FUNCTION = f"struct<name:string,parameters:array<{PARAMETER}>,docstring:string,origin:string>"
VARIABLE = "struct<name:string,kind:string,type:string,value:string,docstring:string>"
MEMBER = "struct<name:string,value:string,docstring:string>"
ENUM = f"struct<name:string,members:array<{MEMBER}>,docstring:string>"

ARRAYS = {"imports": IMPORT, "classes": CLASS, "functions": FUNCTION, "variables": VARIABLE, "enums": ENUM}


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def nothing(element: str) -> Column:
    """An empty array of one element type."""
    return F.array().cast(f"array<{element}>")


def import_row(name: Column, source: Column, items: Column | None = None, direction: str = "import") -> Column:
    return F.struct(
        name.alias("name"),
        source.alias("source"),
        (null("array<string>") if items is None else items).alias("items"),
        F.lit(direction).alias("direction"),
    ).cast(IMPORT)


def parameter_row(name: Column, kind: Column | None = None) -> Column:
    return F.struct(name.alias("name"), (null() if kind is None else kind).alias("type")).cast(PARAMETER)


def base_row(name: Column, access: Column | None = None) -> Column:
    return F.struct(name.alias("name"), (null() if access is None else access).alias("access")).cast(BASE)


def method_row(name: Column, parameters: Column, docstring: Column) -> Column:
    return F.struct(name.alias("name"), parameters.alias("parameters"), docstring.alias("docstring")).cast(METHOD)


def attribute_row(name: Column, kind: Column, static: Column | None = None) -> Column:
    return F.struct(
        name.alias("name"),
        kind.alias("type"),
        (F.lit(False) if static is None else static).alias("static"),
        null().alias("docstring"),
    ).cast(ATTRIBUTE)


def class_row(name: Column, bases: Column, methods: Column, attributes: Column, docstring: Column) -> Column:
    return F.struct(
        name.alias("name"),
        bases.alias("bases"),
        methods.alias("methods"),
        attributes.alias("attributes"),
        docstring.alias("docstring"),
    ).cast(CLASS)


def function_row(name: Column, parameters: Column, docstring: Column, origin: str = "top") -> Column:
    return F.struct(
        name.alias("name"), parameters.alias("parameters"), docstring.alias("docstring"), F.lit(origin).alias("origin")
    ).cast(FUNCTION)


def variable_row(name: Column, kind: Column, type_: Column, value: Column) -> Column:
    return F.struct(
        name.alias("name"), kind.alias("kind"), type_.alias("type"), value.alias("value"), null().alias("docstring")
    ).cast(VARIABLE)


def member_row(name: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"), null().alias("docstring")).cast(MEMBER)


def enum_row(name: Column, members: Column, docstring: Column) -> Column:
    return F.struct(name.alias("name"), members.alias("members"), docstring.alias("docstring")).cast(ENUM)
