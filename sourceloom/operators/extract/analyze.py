"""From source files to one nested row per file, without a shuffle.

Every array is an expression over ``content``, so the whole extraction is one map
stage: no file waits for another one, a hot repository is spread like any other, and
a lost executor costs only its own input splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators.extract import shapes as S
from sourceloom.operators.extract.registry import LANGUAGES, Language

def _by_language(languages: Iterable[Language], build: Callable[[Language], Column], kind: str) -> Column:
    out = F
    for lang in languages:
        out = out.when(F.col("language") == lang.name, build(lang).cast(kind))
    return out.otherwise(F.lit(None).cast(kind))


_EXPRESSIONS: dict[tuple, Column] = {}


def _once(lang: Language, part: str, build: Callable[[], Column]) -> Column:
    """Expressions name their inputs, so one copy per Spark context serves every plan."""
    key = (id(SparkContext._active_spark_context), lang, part)
    if key not in _EXPRESSIONS:
        _EXPRESSIONS[key] = build()
    return _EXPRESSIONS[key]


def unnest(rows: DataFrame, keep: list[str], array: Column | str, alias: str, position: str | None = None) -> DataFrame:
    """One row per array element.

    The outer form with a NULL test above it, because for the inner form the optimizer
    adds a size test below, which would compute the array a second time.
    """
    if position is None:
        out = rows.select(*keep, F.explode_outer(array).alias(alias))
    else:
        out = rows.select(*keep, F.posexplode_outer(array).alias(position, alias))
    return out.where(F.col(alias).isNotNull())


def analyze(files: DataFrame, languages: Iterable[str] | None = None, kinds: Iterable[str] = tuple(S.ARRAYS)) -> DataFrame:
    """``files(.., language, content)`` -> the other columns, ``failure``, ``recovered`` and arrays.

    ``failure`` says why a file gave no facts. A file of a language with a fallback is
    ``recovered`` instead if its damage is judged light.
    """
    langs = [LANGUAGES[n] for n in (languages or LANGUAGES)]
    kinds = tuple(kinds)

    def step(part: str, source: str, kind: str) -> Column:
        return _by_language(
            langs, lambda g: _once(g, part, lambda: getattr(g, part)(F.col(source))), kind
        )

    prepared = files.withColumn("prepared", T.let(step("prepare", "content", "string"), T.shallow))
    itemised = prepared.withColumn("damage", step("rejected", "prepared", "string"))
    if kinds:  # the outcome of a file needs no items, and the fence below would keep them
        found = F.when(F.col("damage").isNull(), step("items", "prepared", "array<string>"))
        itemised = itemised.withColumn("items", F.coalesce(found, F.array().cast("array<string>")))
    recovering = [g for g in langs if g.recoverable is not None]
    rescued = F.lit(False)
    for g in recovering:
        rescued = F.when(
            F.col("damage").isNotNull() & (F.col("language") == g.name), g.recoverable(F.col("content"))
        ).otherwise(rescued)
    kept = [c for c in files.columns if c != "content"]
    # Unnesting a one-element array is a fence: filters and column uses above it cannot
    # pull the expressions below it up a second time.
    fenced = ["damage", *(["items"] if kinds else []), rescued.alias("recovered")]
    found = F.explode(F.array(F.struct(*fenced))).alias("found")
    judged = itemised.select(*kept, "content", found).select(*kept, "content", "found.*")

    def array(kind: str) -> Column:
        def build(g: Language) -> Column:
            primary = g.array(kind, F.col("items"))
            if g.merged is None:
                return primary
            merged = g.merged(F.col("content"), kind, S.nothing(S.ARRAYS[kind]))
            return F.when(F.col("recovered"), merged).otherwise(primary)

        return _by_language(langs, lambda g: _once(g, kind, lambda: build(g)), f"array<{S.ARRAYS[kind]}>")

    failure = F.when(
        F.col("language").isNull(), F.lit("no supported suffix")
    ).otherwise(F.when(~F.col("recovered"), F.col("damage")))
    return judged.select(*kept, failure.alias("failure"), "recovered", *[array(k).alias(k) for k in kinds])
