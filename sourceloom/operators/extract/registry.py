"""Languages and how to add one.

A language is a set of expression builders over ``content``. ``register`` adds one;
every job reads the table at plan time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from sourceloom.operators.extract import cpp, javascript, julia, python
from sourceloom.operators.extract import shapes as S

Builder = Callable[[Column], Column]


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    prepare: Builder
    rejected: Builder
    items: Builder
    imports: Builder
    classes: Builder
    functions: Builder
    variables: Builder
    enums: Builder
    # Files that fail may still give facts: a test on content and a merge per array.
    recoverable: Builder | None = None
    merged: Callable[[Column, str, Column], Column] | None = None

    @property
    def analyzer(self) -> str:
        return f"sourceloom_{self.name}"

    def array(self, kind: str, items: Column) -> Column:
        return getattr(self, kind)(items).cast(f"array<{S.ARRAYS[kind]}>")


def _of(name: str, extensions: tuple[str, ...], module, **extra) -> Language:
    parts = ("prepare", "rejected", "items", "imports", "classes", "functions", "variables", "enums")
    return Language(name, extensions, **{p: getattr(module, p) for p in parts}, **extra)


# Extensions per language.
LANGUAGES: dict[str, Language] = {
    lang.name: lang
    for lang in (
        _of("python", (".py",), python),
        _of("javascript", (".js", ".jsx", ".mjs", ".cjs"), javascript),
        _of("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hxx"), cpp),
        _of("julia", (".jl",), julia, recoverable=julia.recoverable, merged=julia.merged),
    )
}


def register(language: Language) -> None:
    LANGUAGES[language.name] = language


def extension_rows() -> list[tuple[str, str]]:
    return [(ext, lang.name) for lang in LANGUAGES.values() for ext in lang.extensions]
