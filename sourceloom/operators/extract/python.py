"""Python extraction over indentation blocks.

``prepare`` drops comments and joins every bracketed statement to one line; a *block*
is then a line at some indent together with the deeper lines that follow it. Top-level
blocks give imports, classes, functions and variables; the same cut applied to the
body of a class gives its members. Decorated definitions form blocks that start with
``@`` and are left out, as are statements nested under ``if``, ``try`` and so on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators.extract import shapes as S

TOKEN = (
    r"#[^\n]*+"
    r'|"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
    r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"'
    r"|'(?:[^'\\\n]++|\\[\s\S])*+'"
    r"|\\\n|[^#\"'\\]++|[\s\S]"
)
STRAY = "[\"']"

DOTTED = rf"{T.IDENT}(?:\.{T.IDENT})*+"
BLOCK = r"(?m)^(?:@[^\n]*+\n)*+[^ \t\n][^\n]*+(?:\n[ \t][^\n]*+)*+"
DEF = rf"^(?:async[ \t]++)?def[ \t]++({T.IDENT})[ \t]*+(?:{T.SQUARE})?[ \t]*+({T.PAREN})"
CLASS = rf"^class[ \t]++({T.IDENT})[ \t]*+(?:{T.SQUARE})?[ \t]*+({T.PAREN})?[ \t]*+:"
ANNOTATION = f"(?:[^=,{T.BRACKETS}]++|{T.GROUP})++"
PARAM = rf"^\*{{0,2}}[ \t]*+({T.IDENT})[ \t]*+(?::({ANNOTATION}))?(?:=[\s\S]*+)?$"
ASSIGN = rf"^({T.IDENT})[ \t]*+(?::({ANNOTATION}))?(?:=(?!=)([\s\S]*+))?$"
LITERAL_STRING = f"^[A-Za-z]{{0,2}}{T.STRING}$"
# Number, boolean and none literals.
LITERAL_WORD = (
    r"^(?:True|False|None|0[xX][0-9a-fA-F_]++|0[oO][0-7_]++|0[bB][01_]++"
    r"|(?:[0-9][0-9_]*+\.?+[0-9_]*+|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9_]++)?[jJlL]?)$"
)
# Statement keywords that a bare annotation pattern could take for a name.
KEYWORD = r"^(?:else|try|finally|lambda|return|yield|with|if|elif|for|while|except|match|case)\b"
ENUM_BASES = ["Enum", "enum.Enum"]


def prepare(content: Column) -> Column:
    return T.protect(
        content,
        TOKEN,
        is_string=lambda t: (F.length(t) > 1) & (t.startswith('"') | t.startswith("'")),
        is_comment=lambda t: t.startswith("#") | (t == "\\\n"),
        keep_comments=False,
    )


def rejected(prepared: Column) -> Column:
    return T.bracket_state(prepared, STRAY)


def items(prepared: Column) -> Column:
    """Top-level blocks."""
    lines = F.filter(T.logical_lines(prepared), lambda x: T.trimmed(x) != "")

    def statements(line: Column) -> Column:
        indent = F.regexp_extract(line, "^[ \t]*", 0)
        parts = F.filter(T.find(line, f"(?:[^;{T.BRACKETS}]++|{T.GROUP})++"), lambda x: T.trimmed(x) != "")
        return F.transform(parts, lambda x: F.concat(indent, F.ltrim(x)))

    flat = F.when(F.contains(prepared, F.lit(";")), F.flatten(F.transform(lines, statements))).otherwise(lines)
    return blocks(F.array_join(flat, "\n"))


def blocks(body: Column) -> Column:
    return T.find(body, BLOCK)


def _header_end(block: Column) -> Column:
    """What follows the colon of a definition header on the same line."""
    first = F.substring_index(block, "\n", 1)
    return T.no_empty(T.trimmed(F.regexp_extract(first, f"^(?:[^:{T.BRACKETS}]++|{T.GROUP})++:(.*)$", 1)))


def members(block: Column) -> Column:
    """Blocks of the body of a definition."""
    body = F.regexp_extract(block, r"^[^\n]*+\n([\s\S]*+)$", 1)
    indent = F.regexp_extract(body, "^[ \t]*", 0)
    inline = _header_end(block)
    return F.when(inline.isNotNull(), F.array(inline)).otherwise(
        blocks(F.regexp_replace(body, F.concat(F.lit("(?m)^"), indent), F.lit("")))
    )


def docstring(member_blocks: Column) -> Column:
    first = F.get(member_blocks, F.lit(0))
    raw = T.restore(F.when(T.starts(first, LITERAL_STRING), first))

    def clean(s: Column) -> Column:
        bare = T.unquote_triple(s)
        triple = s.startswith('"""') | s.startswith("'''")
        return T.strip(F.when(triple | F.contains(bare, F.lit("\n")), T.dedent(bare)).otherwise(bare))

    return F.when(raw.isNotNull(), T.let(raw, clean))


def parameters(group: Column) -> Column:
    def one(arg: Column) -> Column:
        return F.when(
            T.starts(arg, PARAM),
            S.parameter_row(F.regexp_extract(arg, PARAM, 1), T.no_empty(T.source_text(F.regexp_extract(arg, PARAM, 2)))),
        )

    return T.compact(F.transform(T.arguments(T.inside(group)), one))


def imports(top: Column) -> Column:
    def plain(block: Column) -> Column:
        def one(arg: Column) -> Column:
            source = F.regexp_extract(arg, f"^({DOTTED})", 1)
            alias = F.regexp_extract(arg, rf"[ \t{T.LINE}]as[ \t]++({T.IDENT})$", 1)
            return S.import_row(F.when(alias != "", alias).otherwise(source), source)

        return F.transform(T.arguments(F.regexp_extract(block, r"^import[ \t]++([\s\S]*+)$", 1)), one)

    def selected(block: Column) -> Column:
        pattern = r"^from[ \t]++([^ \t]++)[ \t]++import[ \t]*+([\s\S]*+)$"
        source = F.regexp_extract(block, pattern, 1)
        names = F.regexp_replace(F.regexp_extract(block, pattern, 2), r"^\(|\)$", "")
        listed = F.transform(
            T.arguments(names), lambda a: F.regexp_replace(a, rf"^[\s\S]*[ \t{T.LINE}]as[ \t]++", "")
        )
        return F.when(
            (F.size(listed) > 0) & (source != "") & (source != "__future__"),
            F.array(S.import_row(source, source, listed)),
        ).otherwise(S.nothing(S.IMPORT))

    found = F.filter(top, lambda b: T.starts(b, r"^(?:import|from)[ \t]"))
    return F.flatten(
        F.transform(found, lambda b: F.when(b.startswith("import"), plain(b)).otherwise(selected(b)))
    )


def bases(block: Column) -> Column:
    return F.transform(
        F.filter(T.arguments(T.inside(F.regexp_extract(block, CLASS, 2))), lambda a: T.starts(a, f"^{DOTTED}$")),
        lambda b: S.base_row(b),
    )


def is_enum(block: Column) -> Column:
    return F.exists(bases(block), lambda b: b["name"].isin(ENUM_BASES))


def _assigned(block: Column) -> Column:
    return T.starts(block, ASSIGN) & block.rlike(r"[:=]") & ~T.starts(block, KEYWORD)


def _literal(value: Column) -> Column:
    plain = T.trimmed(value)
    return F.when(T.starts(plain, LITERAL_STRING), T.unquote_triple(T.restore(plain))).when(
        T.starts(plain, LITERAL_WORD), plain
    )


def _callables(found: Column, row) -> Column:
    return F.transform(
        F.filter(found, lambda b: T.starts(b, DEF)),
        lambda b: row(
            F.regexp_extract(b, DEF, 1),
            T.empty_to_null(parameters(F.regexp_extract(b, DEF, 2))),
            docstring(members(b)),
        ),
    )


def attributes(found: Column) -> Column:
    return F.transform(
        F.filter(found, _assigned),
        lambda b: S.attribute_row(
            F.regexp_extract(b, ASSIGN, 1), T.no_empty(T.source_text(F.regexp_extract(b, ASSIGN, 2)))
        ),
    )


def classes(top: Column) -> Column:
    def one(block: Column) -> Column:
        return T.let(
            members(block),
            lambda m: S.class_row(
                F.regexp_extract(block, CLASS, 1),
                T.empty_to_null(bases(block)),
                T.empty_to_null(_callables(m, S.method_row)),
                T.empty_to_null(attributes(m)),
                docstring(m),
            ),
        )

    return F.transform(F.filter(top, lambda b: T.starts(b, CLASS) & ~is_enum(b)), one)


def enums(top: Column) -> Column:
    def member(block: Column) -> Column:
        value = F.regexp_extract(block, ASSIGN, 3)
        call = T.starts(T.trimmed(value), rf"^{DOTTED}{T.PAREN}$")
        return S.member_row(
            F.regexp_extract(block, ASSIGN, 1),
            F.when(call, T.source_text(value)).otherwise(_literal(value)),
        )

    def one(block: Column) -> Column:
        return T.let(
            members(block),
            lambda m: S.enum_row(
                F.regexp_extract(block, CLASS, 1),
                T.empty_to_null(F.transform(F.filter(m, _assigned), member)),
                docstring(m),
            ),
        )

    return F.transform(F.filter(top, lambda b: T.starts(b, CLASS) & is_enum(b)), one)


def functions(top: Column) -> Column:
    return _callables(top, S.function_row)


def variables(top: Column) -> Column:
    def one(block: Column) -> Column:
        name = F.regexp_extract(block, ASSIGN, 1)
        constant = (F.upper(name) == name) & (F.lower(name) != name) & ~name.rlike("[0-9]")
        return S.variable_row(
            name,
            F.when(constant, F.lit("constant")).otherwise(F.lit("external_variable")),
            T.no_empty(T.source_text(F.regexp_extract(block, ASSIGN, 2))),
            _literal(F.regexp_extract(block, ASSIGN, 3)),
        )

    return F.transform(F.filter(top, _assigned), one)
