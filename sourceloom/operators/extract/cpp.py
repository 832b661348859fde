"""C++ extraction over statements.

Statements end at ``;`` or with the body of a function; comments, preprocessor lines
and access labels are statements of their own. Namespaces and linkage blocks are
opened first, so their content counts as top level. Doc comments must directly precede
the declaration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators.extract import shapes as S

TOKEN = (
    r"//(?:[^\n\\]++|\\[\s\S])*+"
    r"|/\*(?:[^*]++|\*(?!/))*+\*/"
    r'|R"([^()\\ \n]{0,16})\((?:[^)]++|\)(?!\1"))*+\)\1"'
    r'|"(?:[^"\\\n]++|\\[\s\S])*+"'
    r"|(?<![0-9a-fA-F])'(?:[^'\\\n]++|\\[^\n])*+'"
    r"|(?<=^|\n)[ \t]*+#(?:[^\n\\/]++|\\[\s\S]|/(?![/*]))*+"
    r"|[^\"'/#\nR]++|[\s\S]"
)
STRAY = '"'

NAME = f"[A-Za-z_\u0080-\ufdcf][{T.WORD}]*+"
WS = f"[ \t\n{T.LINE}]"
ANGLE = "<[^<>;{}]*+>"
MAX_ANGLES = 8  # deeper ones are hidden from the patterns
for _ in range(MAX_ANGLES):
    ANGLE = f"<(?:[^<>;{{}}]++|{ANGLE})*+>"
ARGUMENT = f"(?:[^,<{T.BRACKETS}]++|{T.GROUP}|{ANGLE}|<)++"

# Preprocessor lines are kept as a string token that starts with the stand-in of ``#``.
_HASH = T.STAND_IN[T.SPECIAL.index("#")]
DIRECTIVE = f"{T.S_OPEN}[ \t]*+{_HASH}[^{T.S_CLOSE}]*+{T.S_CLOSE}"
LABEL = rf"(?:public|private|protected)(?:{WS}++[A-Za-z_]++)?{WS}*+:(?!:)"
_TEXT = f"[^;{T.C_OPEN}{T.S_OPEN}{T.BRACKETS}]++"
_STRING = f"(?!{T.S_OPEN}[ \t]*+{_HASH}){T.STRING}"
_PARENS = f"{T.PAREN}|{T.SQUARE}"
_GOES_ON = rf"(?={WS}*+[;,=.(:])"
TYPE_START = rf"(?:template{WS}*+{ANGLE}{WS}*+)*+(?:typedef{WS}++|static{WS}++|const{WS}++|friend{WS}++)*+(?:class|struct|union|enum)\b"
STATEMENT = (
    f"{WS}*+(?:"
    f"{T.COMMENT}|{DIRECTIVE}|{LABEL}"
    rf"|(?={TYPE_START}[^;(){{}}=]*+\{{)(?:{_TEXT}|{_STRING}|{T.COMMENT}|{_PARENS}|{T.BRACE})++;?"
    f"|(?:{_TEXT}|{_STRING}|{_PARENS}|{T.BRACE}{_GOES_ON}|(?<=[^;}}{T.C_CLOSE}\n]){T.COMMENT})++(?:{T.BRACE}|;)?"
    f"|{T.BRACE})"
)

NAMESPACE = (
    rf"(?:(?:inline{WS}++)?namespace\b(?:{WS}++[{T.WORD}:]++)?{WS}*+|extern{WS}*+{T.STRING}{WS}*+)"
    rf"\{{((?:[^{T.BRACKETS}]++|{T.GROUP})*+)\}}"
)
TEMPLATE = rf"^(?:template{WS}*+{ANGLE}{WS}*+)++"

CLASS = (
    rf"^(class|struct){WS}++(?:\[\[[^\]]*+\]\]{WS}*+)?({NAME})(?:{ANGLE})?(?:{WS}++final)?{WS}*+"
    rf"(?::(?!:)([^{{;]*+))?({T.BRACE})"
)
BASE = rf"^(?:virtual{WS}++)?(?:(public|protected|private){WS}++)?(?:virtual{WS}++)?((?:::)?[{T.WORD}:]++(?:{ANGLE})?)$"
ENUM = (
    rf"\benum(?:{WS}++(?:class|struct))?{WS}++({NAME}){WS}*+(?::{WS}*+[{T.WORD}: ]++)?\{{([^{{}}]*+)\}}"
)
# Words that open a statement which declares neither a variable nor a function.
NOT_DECLARATION = (
    r"^(?:using|typedef|friend|return|delete|throw|goto|namespace|class|struct|union|enum|static_assert"
    r"|if|else|for|while|do|switch|case|default|break|continue|new|operator|template)\b"
)
SPECIFIER = r"(?:static|inline|virtual|explicit|constexpr|consteval|extern|friend|const|volatile|mutable|register|thread_local|constinit)"
_WIDTH = r"(?:unsigned|signed|long|short|int|char|double)"
TYPE = (
    rf"(?:{_WIDTH}\b(?:{WS}++{_WIDTH}\b)*+"
    rf"|(?:(?:struct|class|enum|typename){WS}++)?(?:::)?{NAME}(?:{ANGLE})?(?:::{NAME}(?:{ANGLE})?)*+)"
)
_HEAD = rf"^(?:\[\[[^\]]*+\]\]{WS}*+)?(?:{SPECIFIER}{WS}++)*+"
# A callable: direct return type (or none, for constructors) and a plain name.
_TAIL = rf"{WS}*+((?:const|noexcept|override|final|volatile|&&?|->|=|:(?!:)|try)\b[\s\S]*+|[{{;:=&\-][\s\S]*+|(?:const|noexcept|override|final)[\s\S]*+)?$"
CALLABLE = rf"{_HEAD}(?:(?!{NAME}{WS}*+\()({TYPE}){WS}++(?:const{WS}++)?)?({NAME}){WS}*+({T.PAREN}){_TAIL}"
_VALUE = f"(?:[^,;<{T.BRACKETS}]++|{T.GROUP}|{ANGLE}|<)*+"
VARIABLE = (
    rf"^((?:{SPECIFIER}{WS}++)*+)({TYPE}){WS}++((?:(?:const|volatile){WS}++)*+)({NAME}){WS}*+(\[[^\]]*+\])?{WS}*+"
    rf"(=(?!=){_VALUE}|{T.BRACE}|{T.PAREN})?{WS}*+(?:,[\s\S]*+)?;?$"
)
PARAM = (
    rf"^(?:(?:const|volatile|register|struct|class|enum|typename){WS}++)*+({TYPE})((?:{WS}*+const)?){WS}*+(&&?|\*++|){WS}*+"
    rf"(?:const{WS}++)?({NAME})?{WS}*+(\[[^\]]*+\])?$"
)


def shallow_angles(prepared: Column) -> Column:
    """Text whose template arguments of any depth nest at most ``MAX_ANGLES`` times; inner brackets get stand-ins."""
    many = f"(?:<[^<;{{}}]*+){{{MAX_ANGLES + 1}}}"

    def paired(part: Column) -> Column:
        # as many rounds as there are brackets; those after the last change cost nothing
        def step(acc: Column, _: Column) -> Column:
            def once(t: Column) -> Column:
                new = F.regexp_replace(t, "<([^<>]*+)>", f"{T.A_OPEN}$1{T.A_CLOSE}")
                return T.let(new, lambda n: F.struct(n.alias("text"), (n != t).alias("more")))

            return F.when(acc["more"], once(acc["text"])).otherwise(acc)

        rounds = F.sequence(F.lit(1), F.length(part) - F.length(F.translate(part, "<", "")))
        return F.aggregate(rounds, F.struct(part.alias("text"), F.lit(True).alias("more")), step)["text"]

    def shown(marked: Column) -> Column:
        # the pairs down to the depth of the patterns become brackets again
        tokens = T.find(marked, f"[{T.A_OPEN}{T.A_CLOSE}]|[^{T.A_OPEN}{T.A_CLOSE}]++")

        def step(acc: Column, t: Column) -> Column:
            depth = acc["depth"] + F.when(t == T.A_OPEN, 1).otherwise(0)
            seen = F.when(depth <= MAX_ANGLES, F.translate(t, T.A_OPEN + T.A_CLOSE, "<>")).otherwise(t)
            return F.struct(
                F.concat(acc["text"], seen).alias("text"), (depth - F.when(t == T.A_CLOSE, 1).otherwise(0)).alias("depth")
            )

        return F.aggregate(tokens, F.struct(F.lit("").alias("text"), F.lit(0).alias("depth")), step)["text"]

    def part(p: Column) -> Column:
        return F.when(p.rlike(many), T.let(paired(p), shown)).otherwise(p)

    return T.let(
        prepared,
        lambda x: F.when(x.rlike(many), F.array_join(F.transform(T.find(x, "[^;{}]++|[;{}]"), part), "")).otherwise(x),
    )


def prepare(content: Column) -> Column:
    return shallow_angles(_protected(content))


def _protected(content: Column) -> Column:
    return T.protect(
        content,
        TOKEN,
        is_string=lambda t: T.starts(t, r"^[ \t]*+#") | ((F.length(t) > 1) & T.starts(t, "^R?[\"']")),
        is_comment=lambda t: t.startswith("//") | t.startswith("/*"),
        keep_comments=True,
    )


def rejected(prepared: Column) -> Column:
    return T.bracket_state(prepared, STRAY)


def opened(prepared: Column) -> Column:
    """Text with namespace and linkage blocks replaced by their content."""
    prepared = F.regexp_replace(prepared, rf"\bextern{WS}*+{T.STRING}{WS}*+(?!\{{)", "")

    def step(acc: Column, _: Column) -> Column:
        # rounds after the last change cost nothing
        def once(t: Column) -> Column:
            new = T.let(F.regexp_replace(t, NAMESPACE, "\n$1\n"), T.deeper)
            return T.let(new, lambda n: F.struct(n.alias("text"), n.rlike(NAMESPACE).alias("more")))

        return F.when(acc["more"], once(acc["text"])).otherwise(acc)

    levels = F.size(F.split(T.revealed(prepared), r"\{"))  # no more than braces
    return F.when(
        prepared.rlike(NAMESPACE),
        F.aggregate(F.sequence(F.lit(1), levels), F.struct(prepared.alias("text"), F.lit(True).alias("more")), step)["text"],
    ).otherwise(prepared)


def _one_line(found: Column) -> Column:
    return F.filter(F.transform(found, lambda x: T.trimmed(F.translate(x, "\n", T.LINE))), lambda x: x != "")


def items(prepared: Column) -> Column:
    return _one_line(T.find(opened(prepared), STATEMENT))


def members(body: Column, show: Callable[[Column], Column] = lambda t: t) -> Column:
    return _one_line(T.find(show(F.translate(T.inside(body), T.LINE, "\n")), STATEMENT))


def documented(lines: Column) -> Column:
    """``struct(line, doc)`` per statement with the comment run right before it."""
    block = f"({T.C_OPEN}{_hidden('/**')}[^{T.C_CLOSE}]*+{T.C_CLOSE})"
    line = f"{T.C_OPEN}{_hidden('//')}[^{T.C_CLOSE}]*+{T.C_CLOSE}"

    def one(run: Column) -> Column:
        comments = F.regexp_extract(run, f"^((?:{T.COMMENT}\n)*+)", 1)
        code = F.substring(run, F.length(comments) + 1, F.length(run))
        doc_block = T.pick(comments, f"{block}\n(?:{line}\n)*+$", 1)
        doc_lines = T.find(T.pick(comments, f"((?:{line}\n)++)$", 1), line)
        doc = F.when(doc_block.isNotNull(), T.comment_text(T.restore(doc_block))).otherwise(
            T.no_empty(
                T.strip(
                    F.array_join(
                        F.transform(doc_lines, lambda c: T.strip(F.regexp_replace(T.restore(c), "^//", ""))), "\n"
                    )
                )
            )
        )
        # A template is a level of its own, so comments before it do not reach its content.
        return F.struct(
            F.regexp_replace(code, TEMPLATE, "").alias("line"), F.when(~T.starts(code, TEMPLATE), doc).alias("doc")
        )

    runs = T.find(F.array_join(lines, "\n"), f"(?m)^(?:{T.COMMENT}\n)*+[^{T.C_OPEN}\n][^\n]*+")
    return F.transform(runs, one)


def _hidden(chars: str) -> str:
    return "".join(T.STAND_IN[T.SPECIAL.index(c)] for c in chars)


def imports(lines: Column) -> Column:
    include = F.filter(lines, lambda x: T.starts(x, f"^{T.S_OPEN}[ \t]*+{_HASH}[ \t]*+include"))

    def one(x: Column) -> Column:
        path = T.pick(T.restore(x), r"^\s*+#\s*+include\s*+[<\"]([^>\"]*+)[>\"]", 1)
        return F.when(path.isNotNull(), S.import_row(path, path))

    return T.compact(F.transform(include, one))


def arguments(group: Column) -> Column:
    return F.filter(F.transform(T.find(T.inside(group), ARGUMENT), T.trimmed), lambda a: a != "")


def parameters(group: Column) -> Column:
    def one(arg: Column) -> Column:
        plain = T.trimmed(F.regexp_extract(arg, f"^((?:[^={T.BRACKETS}]++|{T.GROUP})++)", 1))

        def row(p: Column) -> Column:
            mark = F.regexp_extract(p, PARAM, 3)
            suffix = (
                F.when(mark.startswith("&"), F.lit("&"))
                .when(mark == "*", F.lit("*"))
                .when(F.regexp_extract(p, PARAM, 5) != "", F.lit("[]"))
                .otherwise(F.lit(""))
            )
            name = T.pick(p, PARAM, 4)
            return F.when(p == "...", S.parameter_row(F.lit("..."), F.lit("..."))).when(
                name.isNotNull() & (F.length(mark) < 3) & (mark != "**"),
                S.parameter_row(name, F.concat(T.source_text(F.regexp_extract(p, PARAM, 1)), suffix)),
            )

        return T.let(plain, row)

    return T.compact(F.transform(arguments(group), one))


def bases(line: Column) -> Column:
    default = F.when(F.regexp_extract(line, CLASS, 1) == "class", F.lit("private")).otherwise(F.lit("public"))
    listed = F.filter(
        F.transform(T.find(F.regexp_extract(line, CLASS, 3), ARGUMENT), T.trimmed), lambda b: T.starts(b, BASE)
    )
    return F.transform(
        listed,
        lambda b: S.base_row(
            T.source_text(F.regexp_extract(b, BASE, 2)), F.coalesce(T.pick(b, BASE, 1), default)
        ),
    )


def _callable(line: Column) -> Column:
    return T.starts(line, CALLABLE) & ~T.starts(line, NOT_DECLARATION)


def _variable(line: Column) -> Column:
    return T.starts(line, VARIABLE) & ~T.starts(line, NOT_DECLARATION) & ~_callable(line)


def _methods(found: Column) -> Column:
    return F.transform(
        F.filter(found, lambda d: _callable(d.line)),
        lambda d: S.method_row(
            F.regexp_extract(d.line, CALLABLE, 2),
            T.empty_to_null(parameters(F.regexp_extract(d.line, CALLABLE, 3))),
            d.doc,
        ),
    )


def _fields(found: Column) -> Column:
    return F.transform(
        F.filter(found, lambda d: _variable(d.line) & (F.regexp_extract(d.line, VARIABLE, 5) == "")),
        lambda d: S.attribute_row(
            F.regexp_extract(d.line, VARIABLE, 4), T.source_text(F.regexp_extract(d.line, VARIABLE, 2))
        ),
    )


def levels(lines: Column) -> Column:
    """Documented statements of the file and of all class bodies, however deeply nested."""
    def inner(found: Column) -> Column:
        held = F.filter(found, lambda d: T.starts(d.line, CLASS))
        show = lambda t: T.let(t, T.deeper)
        return F.flatten(F.transform(held, lambda d: documented(members(F.regexp_extract(d.line, CLASS, 4), show))))

    def step(acc: Column, _: Column) -> Column:
        return F.when(F.size(acc["fresh"]) == 0, acc).otherwise(
            T.let(inner(acc["fresh"]), lambda n: F.struct(F.concat(acc["every"], n).alias("every"), n.alias("fresh")))
        )

    return T.let(
        documented(lines),
        lambda top: F.aggregate(
            F.sequence(F.lit(1), F.size(F.split(T.revealed(F.array_join(lines, "")), r"\{"))),  # no more levels than braces
            F.struct(top.alias("every"), top.alias("fresh")),
            step,
        )["every"],
    )


def classes(lines: Column) -> Column:
    """Classes and structs of the file and, as rows of their own, those inside other classes."""
    def one(d: Column) -> Column:
        return T.let(
            documented(members(F.regexp_extract(d.line, CLASS, 4))),
            lambda m: S.class_row(
                F.regexp_extract(d.line, CLASS, 2),
                T.empty_to_null(bases(d.line)),
                T.empty_to_null(_methods(m)),
                T.empty_to_null(_fields(m)),
                d.doc,
            ),
        )

    return F.transform(F.filter(levels(lines), lambda d: T.starts(d.line, CLASS)), one)


def functions(lines: Column) -> Column:
    def one(d: Column) -> Column:
        prototype = d.line.rlike(";$")
        return S.function_row(
            F.regexp_extract(d.line, CALLABLE, 2),
            T.empty_to_null(parameters(F.regexp_extract(d.line, CALLABLE, 3))),
            F.when(~prototype, d.doc),
        )

    return F.transform(F.filter(documented(lines), lambda d: _callable(d.line)), one)


def variables(lines: Column) -> Column:
    def one(x: Column) -> Column:
        qualifiers = F.regexp_replace(
            T.trimmed(F.concat(F.regexp_extract(x, VARIABLE, 1), F.regexp_extract(x, VARIABLE, 3))), f"{WS}++", " "
        )
        array = F.regexp_extract(x, VARIABLE, 5) != ""
        start = F.regexp_extract(x, VARIABLE, 6)
        type_ = F.concat(
            F.when(qualifiers != "", F.concat(qualifiers, F.lit(" "))).otherwise(F.lit("")),
            T.source_text(F.regexp_extract(x, VARIABLE, 2)),
            F.when(array, F.lit("[]")).otherwise(F.lit("")),
        )
        return T.let(
            type_,
            lambda t: F.when(
                ~array | (start != ""),
                S.variable_row(
                    F.regexp_extract(x, VARIABLE, 4),
                    F.when(F.contains(t, F.lit("const")), F.lit("constant")).otherwise(F.lit("external_variable")),
                    t,
                    T.no_empty(T.source_text(F.regexp_replace(start, "^=", ""))),
                ),
            ),
        )

    return T.compact(F.transform(F.filter(lines, _variable), one))


def enums(lines: Column) -> Column:
    pattern = rf"^(?:typedef{WS}++)?{ENUM}"

    def member(a: Column) -> Column:
        bare = T.trimmed(F.regexp_replace(a, T.COMMENT, ""))
        shape = rf"^({NAME}){WS}*+(?:=([\s\S]++))?$"
        return F.when(
            T.starts(bare, shape),
            S.member_row(
                F.regexp_extract(bare, shape, 1), T.no_empty(T.source_text(F.regexp_extract(bare, shape, 2)))
            ),
        )

    def one(d: Column) -> Column:
        listed = T.find(F.regexp_extract(d.line, pattern, 2), ARGUMENT)
        return S.enum_row(
            F.regexp_extract(d.line, pattern, 1), T.empty_to_null(T.compact(F.transform(listed, member))), d.doc
        )

    return F.transform(F.filter(levels(lines), lambda d: T.starts(d.line, pattern)), one)
