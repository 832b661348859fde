"""JavaScript extraction over logical lines.

A logical line ends at ``;`` or at a line end outside brackets, so a class or function
with its whole body is one line, and so is a comment. Declarations are looked up by
anchored patterns on those lines; class members by cutting the class body the same way.
A doc comment belongs to the next class or function of its level when no other class
or function stands between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators.extract import shapes as S

TOKEN = (
    r"//[^\n]*+"
    r"|/\*(?:[^*]++|\*(?!/))*+\*/"
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"'
    r"|'(?:[^'\\\n]++|\\[\s\S])*+'"
    r"|`(?:[^`\\]++|\\[\s\S])*+`"
    # A slash after an operator or an opening bracket starts a pattern literal, whatever blanks lie between: plain
    # text stops after the operator, and the literal takes the blanks.
    r"|(?<=[=(,:!&|?\[]|\breturn)[ \t]*+/(?![/*])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
    r"|return(?=[ \t]*+/)"
    r"|(?:[^\"'`/=(,:!&|?\[r]++|r(?!eturn[ \t]*+/)|[=(,:!&|?\[](?![ \t]*+/))++|[\s\S]"
)
STRAY = "`"

NAME = f"[A-Za-z_$\u0080-\ufdcf][{T.WORD}$]*+"
WS = f"[ \t{T.LINE}]"
_LONE = r"(?=[ \t]*+(?:\n|\z))"
_GOES_ON = r"(?![ \t]*+(?:\n|\z))"
STATEMENT = (
    f"{T.COMMENT}{_LONE}"
    f"|(?:[^\n;{T.C_OPEN}{T.BRACKETS}]++|{T.GROUP}|{T.COMMENT}{_GOES_ON})++"
)

FUNCTION = rf"^(?:async{WS}++)?function{WS}++({NAME}){WS}*+({T.PAREN})"
CLASS = (
    rf"^class{WS}++({NAME})(?:{WS}++extends{WS}++((?:[^{T.BRACKETS}]++|{T.PAREN}|{T.SQUARE})++))?"
    rf"{WS}*+({T.BRACE})"
)
DECLARATION = rf"(?:(?:async{WS}++)?function{WS}++{NAME}{WS}*+\(|class{WS}++{NAME})"
ARROW = rf"^({NAME}){WS}*+={WS}*+(?:async{WS}*+)?({T.PAREN}|{NAME}){WS}*+=>"
VARIABLE = rf"^(const|let|var)(?:{WS}++|(?=[\[{{]))([\s\S]++)$"
DECLARATOR = rf"^({NAME}|{T.BRACE}|{T.SQUARE}){WS}*+(?:=(?![=>])([\s\S]++))?$"

PROPERTY = rf"(?:#?{NAME}|{T.STRING}|[0-9]++|{T.SQUARE})"
_W = r"[ \t\n]"
METHOD_HEAD = rf"(?:(?:static|async|get|set){WS}++(?![(=;]))*+[*]?{WS}*+"
METHOD = rf"^{METHOD_HEAD}({PROPERTY}){WS}*+({T.PAREN}){WS}*+{T.BRACE}$"
METHOD_START = rf"{METHOD_HEAD}{PROPERTY}{WS}*+{T.PAREN}{WS}*+\{{"
FIELD = rf"^(static{WS}++(?![(=;]))?({PROPERTY}){WS}*+(?:=(?!=)[\s\S]*+)?$"
MEMBER = (
    f"{T.COMMENT}"
    rf"|@[A-Za-z_$][{T.WORD}$.]*+(?:{T.PAREN})?"
    rf"|{_W}*+(?:(?:static|async|get|set){_W}++(?![(=;]))*+[*]?{_W}*+{PROPERTY}{_W}*+{T.PAREN}{_W}*+{T.BRACE}"
    rf"|{_W}*+static{_W}*+{T.BRACE}"
    f"|(?:[^;\n{T.C_OPEN}{T.BRACKETS}]++|{T.GROUP})++"
)


def prepare(content: Column) -> Column:
    protected = T.protect(
        content,
        TOKEN,
        is_string=lambda t: (F.length(t) > 1) & T.starts(t, "^[ \t]*+[\"'`/]"),
        is_comment=lambda t: t.startswith("//") | t.startswith("/*"),
        keep_comments=True,
    )
    # The blanks before a pattern literal are not part of it.
    protected = F.regexp_replace(protected, f"{T.S_OPEN}([ \t]++)", f"$1{T.S_OPEN}")
    # A statement goes on over a line end after an operator or before a member access.
    joined = F.regexp_replace(protected, r"(?<=[=,+*&|?:])[ \t]*+\n(?=[ \t\n]*+[^ \t\n])", T.LINE)
    return F.regexp_replace(joined, r"\n(?=[ \t]*+[.?&|+,])", T.LINE)


def rejected(prepared: Column) -> Column:
    return T.bracket_state(prepared, STRAY)


def _one_line(found: Column) -> Column:
    return F.filter(F.transform(found, lambda x: T.trimmed(F.translate(x, "\n", T.LINE))), lambda x: x != "")


def items(prepared: Column) -> Column:
    """Statements and comments of the file, one line each."""
    return _one_line(T.find(prepared, STATEMENT))


def members(body: Column) -> Column:
    return _one_line(T.find(F.translate(T.inside(body), T.LINE, "\n"), MEMBER))


def documented(lines: Column, declaration: str) -> Column:
    """``struct(line, doc)`` per declaration: the nearest comment since the one before."""
    chunk = rf"(?m)^(?:(?!{declaration})[^\n]*+\n)*+(?:{declaration}[^\n]*+|[^\n]*+\z)"

    def one(c: Column) -> Column:
        comment = T.restore(F.try_element_at(T.find(c, f"(?m)^{T.COMMENT}$"), F.lit(-1)))
        doc = F.when(comment.startswith("/**") & (F.length(comment) > 4), T.comment_text(comment))
        return F.struct(F.substring_index(c, "\n", -1).alias("line"), doc.alias("doc"))

    chunks = F.filter(T.find(F.array_join(lines, "\n"), chunk), lambda c: c != "")
    return F.transform(chunks, one)


def _source(text: Column) -> Column:
    return T.unquote(T.source_text(text), "\"'`")


def _aliases(listed: Column) -> Column:
    """Pieces of a ``{ a, b as c }`` clause as struct(original, visible)."""
    return F.transform(
        T.arguments(listed),
        lambda a: F.struct(
            F.regexp_extract(a, f"^([^ \t{T.LINE}]++)", 1).alias("original"),
            F.regexp_extract(a, f"([^ \t{T.LINE}]++)$", 1).alias("visible"),
        ),
    )


IMPORT = (
    rf"^import(?:{WS}++|(?=[{{*{T.S_OPEN}]))(?:({NAME}){WS}*+,?{WS}*+)?(?:\*{WS}*+as{WS}++({NAME}){WS}*+)?"
    rf"({T.BRACE})?{WS}*+(?:from{WS}*+)?({T.STRING})"
)


def imported(lines: Column) -> Column:
    def one(line: Column) -> Column:
        default = T.pick(line, IMPORT, 1)
        space = T.pick(line, IMPORT, 2)
        source = _source(F.regexp_extract(line, IMPORT, 4))

        def rows(parts: Column) -> Column:
            renamed = F.filter(parts, lambda p: (p.original == "default") & (p.visible != "default"))
            named = T.empty_to_null(
                F.transform(
                    F.filter(parts, lambda p: ~((p.original == "default") & (p.visible != "default"))),
                    lambda p: p.visible,
                )
            )
            name = F.coalesce(default, F.get(renamed, F.lit(0)).visible)
            return (
                F.when(name.isNotNull(), S.import_row(name, source, named))
                .when(space.isNotNull(), S.import_row(space, source, F.array(F.lit("*"))))
                .otherwise(S.import_row(S.null(), source, named))
            )

        return T.let(_aliases(T.inside(F.regexp_extract(line, IMPORT, 3))), rows)

    return F.transform(F.filter(lines, lambda x: T.starts(x, IMPORT)), one)


def exported(lines: Column) -> Column:
    def row(name: Column, source: Column, items: Column) -> Column:
        return F.array(S.import_row(name, source, items, "export"))

    own = F.lit("self")

    def default(rest: Column) -> Column:
        declared = F.coalesce(T.pick(rest, FUNCTION, 1), T.pick(rest, CLASS, 1), T.pick(rest, f"^({NAME})$", 1))
        return row(
            F.coalesce(declared, F.lit("default")), F.coalesce(declared, own), F.array(F.lit("default"))
        )

    def clause(rest: Column) -> Column:
        names = F.transform(_aliases(T.inside(F.regexp_extract(rest, f"^({T.BRACE})", 1))), lambda p: p.visible)
        source = _source(T.pick(rest, rf"^{T.BRACE}{WS}*+from{WS}*+({T.STRING})", 1))
        return F.when(F.size(names) > 0, row(source, F.coalesce(source, own), names)).otherwise(S.nothing(S.IMPORT))

    def star(rest: Column) -> Column:
        pattern = rf"^\*{WS}*+(?:as{WS}++({NAME}){WS}*+)?from{WS}*+({T.STRING})"
        space = T.pick(rest, pattern, 1)
        source = _source(T.pick(rest, pattern, 2))
        return F.when(source.isNull(), S.nothing(S.IMPORT)).otherwise(
            row(
                F.coalesce(space, source),
                source,
                F.array(F.coalesce(F.concat(F.lit("* as "), space), F.lit("*"))),
            )
        )

    def declared(rest: Column) -> Column:
        name = F.coalesce(T.pick(rest, FUNCTION, 1), T.pick(rest, CLASS, 1))
        return F.when(name.isNotNull(), row(name, own, F.array(name))).otherwise(S.nothing(S.IMPORT))

    def one(line: Column) -> Column:
        rest = T.trimmed(F.regexp_replace(line, f"^export{WS}*+", ""))
        return T.let(
            rest,
            lambda r: F.when(T.starts(r, rf"^default\b"), default(T.trimmed(F.regexp_replace(r, "^default", ""))))
            .when(r.startswith("{"), clause(r))
            .when(r.startswith("*"), star(r))
            .when(
                T.starts(r, VARIABLE),
                F.transform(
                    _declared(r),
                    lambda v: S.import_row(v["name"], own, F.array(v["name"]), "export"),
                ),
            )
            .otherwise(declared(r)),
        )

    return F.flatten(F.transform(F.filter(lines, lambda x: T.starts(x, rf"^export(?:{WS}|[{{*])")), one))


def imports(lines: Column) -> Column:
    """Imports, then exports; both are kept in one list and told apart by ``direction``."""
    return F.concat(imported(lines), exported(lines))


def parameters(group: Column) -> Column:
    def one(arg: Column) -> Column:
        name = T.source_text(F.regexp_extract(arg, f"^((?:[^={T.BRACKETS}]++|{T.GROUP})++)", 1))
        return S.parameter_row(F.regexp_replace(name, r"^\.\.\.\s*+", "..."))

    return F.transform(T.arguments(T.inside(group)), one)


def _methods(lines: Column) -> Column:
    found = F.filter(documented(lines, METHOD_START), lambda d: T.starts(d.line, METHOD))
    return F.transform(
        found,
        lambda d: S.method_row(
            T.source_text(F.regexp_extract(d.line, METHOD, 1)),
            T.empty_to_null(parameters(F.regexp_extract(d.line, METHOD, 2))),
            d.doc,
        ),
    )


def _fields(lines: Column) -> Column:
    found = F.filter(lines, lambda x: T.starts(x, FIELD) & ~T.starts(x, f"^{T.C_OPEN}"))
    return F.transform(
        found,
        lambda x: S.attribute_row(
            T.source_text(F.regexp_extract(x, FIELD, 2)), S.null(), F.regexp_extract(x, FIELD, 1) != ""
        ),
    )


def classes(lines: Column) -> Column:
    def one(d: Column) -> Column:
        base = T.pick(d.line, CLASS, 2)
        return T.let(
            members(F.regexp_extract(d.line, CLASS, 3)),
            lambda m: S.class_row(
                F.regexp_extract(d.line, CLASS, 1),
                F.when(base.isNotNull(), F.array(S.base_row(T.source_text(base)))),
                T.empty_to_null(_methods(m)),
                T.empty_to_null(_fields(m)),
                d.doc,
            ),
        )

    return F.transform(F.filter(documented(lines, DECLARATION), lambda d: T.starts(d.line, CLASS)), one)


def functions(lines: Column) -> Column:
    declared = F.transform(
        F.filter(documented(lines, DECLARATION), lambda d: T.starts(d.line, FUNCTION)),
        lambda d: S.function_row(
            F.regexp_extract(d.line, FUNCTION, 1),
            T.empty_to_null(parameters(F.regexp_extract(d.line, FUNCTION, 2))),
            d.doc,
        ),
    )
    # Only a bracketed list counts as parameters of an arrow, as in the declaration form.
    arrows = F.transform(
        F.filter(lines, lambda x: T.starts(x, ARROW)),
        lambda x: S.function_row(
            F.regexp_extract(x, ARROW, 1),
            T.empty_to_null(parameters(T.pick(F.regexp_extract(x, ARROW, 2), r"^(\([\s\S]*+)$", 1))),
            S.null(),
            "arrow",
        ),
    )
    return F.concat(declared, arrows)


def _declared(line: Column) -> Column:
    kind = F.when(F.regexp_extract(line, VARIABLE, 1) == "const", F.lit("constant")).otherwise(
        F.lit("external_variable")
    )
    found = F.filter(T.arguments(F.regexp_extract(line, VARIABLE, 2)), lambda a: T.starts(a, DECLARATOR))

    def one(a: Column) -> Column:
        value = T.trimmed(F.regexp_extract(a, DECLARATOR, 2))
        text = T.restore(value)
        return S.variable_row(
            T.source_text(F.regexp_extract(a, DECLARATOR, 1)),
            kind,
            S.null(),
            F.when(a.rlike("="), F.when(T.starts(value, f"^{T.STRING}$"), T.unquote(text, "\"'`")).otherwise(text)),
        )

    return F.transform(found, one)


def variables(lines: Column) -> Column:
    return F.flatten(F.transform(F.filter(lines, lambda x: T.starts(x, VARIABLE)), _declared))


def enums(lines: Column) -> Column:
    return S.nothing(S.ENUM)
