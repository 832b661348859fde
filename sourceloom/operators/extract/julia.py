"""Julia extraction over keyword blocks.

``prepare`` marks every block keyword outside brackets and its ``end`` as a bracket
pair, so ``function .. end``, ``struct .. end`` and so on become single logical lines.
Keywords inside brackets (comprehensions, ``a[end]``) open no block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators.extract import shapes as S

TOKEN = (
    r"#=(?:[^=]++|=(?!#))*+=#"
    r"|#[^\n]*+"
    r'|"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
    r'|"(?:[^"\\]++|\\[\s\S])*+"'
    # A quote after a value is a transpose, elsewhere it opens a character.
    r"|(?<=[A-Za-z0-9_)\]}.'])'"
    r"|'(?:[^'\\\n]|\\[^\n']++|\\')'"
    r"|[^\"'#]++|[\s\S]"
)
STRAY = '"'

NAME = f"[A-Za-z_\u0080-﷏][{T.WORD}!]*+"
DOTTED = rf"{NAME}(?:\.{NAME})*+"
WS = f"[ \t{T.LINE}]"
_PLAIN = r"(?<![A-Za-z0-9_!:.@\u0080-﷏])"
OPENERS = r"(function|macro|struct|module|baremodule|if|for|while|begin|let|try|quote|do|abstract[ \t]+type|primitive[ \t]+type)"
_AFTER = r"(?![A-Za-z0-9_!\u0080-﷏])"

FUNCTION = rf"^{T.B_OPEN}function{WS}++({NAME})({T.PAREN})"
SHORT = rf"^({NAME})({T.PAREN})(?:::[^=\n]*?)?(?:{WS}++where{WS}[^=\n]*?)?{WS}*+=(?![=>])"
MACRO = rf"^{T.B_OPEN}macro{WS}++({NAME})({T.PAREN})"
STRUCT = rf"^(?:mutable{WS}++)?{T.B_OPEN}struct{WS}++({NAME})(?:{T.BRACE})?(?:{WS}*+<:{WS}*+({NAME})(?![.{{]))?"
CONST = rf"^const{WS}++({NAME}){WS}*+=(?![=>])([\s\S]*+)$"
VARIABLE = rf"^({NAME}){WS}*+=(?![=>])([\s\S]*+)$"
IMPORT = rf"^(using|import){WS}++([\s\S]++)$"
MODULE = rf"^{T.B_OPEN}(?:bare)?module{WS}++({NAME})"
FIELD = rf"^(?:const{WS}++)?({NAME})::([\s\S]++)$"
PARAM = rf"^({NAME})(?:::((?:[^={T.BRACKETS}]++|{T.GROUP})++))?{WS}*+(?:=(?!=)[\s\S]*+)?$"
LITERAL = r"^(?:0[xob][0-9a-fA-F_]++|[0-9][0-9_]*+(?:\.[0-9_]*+)?(?:[eEf][+-]?[0-9_]++)?|\.[0-9][0-9_]*+(?:[eEf][+-]?[0-9]++)?)$"
# Texts that make an assignment a type alias.
CONTAINERS = ["Vector{", "Matrix{", "Array{", "Dict{", "Set{", "Tuple{"]


def prepare(content: Column) -> Column:
    protected = T.protect(
        content,
        TOKEN,
        is_string=lambda t: (F.length(t) > 1) & (t.startswith('"') | t.startswith("'")),
        is_comment=lambda t: t.startswith("#"),
        keep_comments=False,
    )
    piece = f"{_plain_group()}|[^()\\[\\]{{}}]++|[\\s\\S]"

    def mark(t: Column) -> Column:
        opened = F.regexp_replace(t, f"{_PLAIN}{OPENERS}{_AFTER}", f"{T.B_OPEN}$1")
        return F.when(T.starts(t, r"^[(\[{]"), t).otherwise(
            F.regexp_replace(opened, f"{_PLAIN}end{_AFTER}", f"end{T.B_CLOSE}")
        )

    return F.array_join(F.transform(T.find(T.let(protected, T.shallow), piece), mark), "")


def _plain_group() -> str:
    return T.nested(r"(\[{", r")\]}")


def rejected(prepared: Column) -> Column:
    return T.bracket_state(prepared, STRAY)


def items(prepared: Column) -> Column:
    return _lines(prepared)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(T.logical_lines(text, separators="\n;"), T.trimmed), lambda x: x != "")


def body(block: Column) -> Column:
    """Logical lines inside a keyword block, without its first and last line part."""
    return _lines(F.regexp_replace(F.translate(block, T.LINE, "\n"), rf"^[^{T.B_OPEN}]*+{T.B_OPEN}|end{T.B_CLOSE}$", ""))


def documented(lines: Column) -> Column:
    """``struct(line, doc)``: a string literal right before a line is its doc."""
    def pairs(every: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(every, i - 1))
            raw = T.restore(F.when(T.starts(before, f"^{T.STRING}$"), before))
            return F.struct(line.alias("line"), T.strip(T.unquote_triple(raw)).alias("doc"))

        return F.transform(every, one)

    return T.let(lines, pairs)


def modules(lines: Column) -> Column:
    """Names of the modules at file level."""
    return F.transform(F.filter(lines, lambda x: T.starts(x, MODULE)), lambda x: F.regexp_extract(x, MODULE, 1))


def module_lines(lines: Column) -> Column:
    """``struct(line, doc)`` of the lines directly inside file-level modules."""
    return F.flatten(F.transform(F.filter(lines, lambda x: T.starts(x, MODULE)), lambda x: documented(body(x))))


def _with_modules(lines: Column) -> Column:
    return F.concat(documented(lines), module_lines(lines))


def module_members(lines: Column) -> Column:
    """``struct(module, kind, name)`` of everything directly inside file-level modules."""
    def one(block: Column) -> Column:
        name = F.regexp_extract(block, MODULE, 1)

        def member(line: Column) -> Column:
            def row(kind: str, value: Column) -> Column:
                return F.struct(name.alias("module"), F.lit(kind).alias("kind"), value.alias("name"))

            return (
                F.when(T.starts(line, IMPORT), row("import", F.regexp_extract(F.regexp_extract(line, IMPORT, 2), f"^({DOTTED})", 1)))
                .when(T.starts(line, FUNCTION), row("function", F.regexp_extract(line, FUNCTION, 1)))
                .when(T.starts(line, SHORT), row("function", F.regexp_extract(line, SHORT, 1)))
                .when(T.starts(line, STRUCT), row("struct", F.regexp_extract(line, STRUCT, 1)))
                .when(T.starts(line, CONST), row("constant", F.regexp_extract(line, CONST, 1)))
                .when(T.starts(line, VARIABLE), row("variable", F.regexp_extract(line, VARIABLE, 1)))
            )

        return T.compact(F.transform(body(block), member))

    return F.flatten(F.transform(F.filter(lines, lambda x: T.starts(x, MODULE)), one))


def imports(lines: Column) -> Column:
    def one(d: Column) -> Column:
        rest = F.regexp_extract(d.line, IMPORT, 2)
        source = T.pick(rest, f"^({DOTTED})", 1)
        selected = T.pick(rest, rf"^{DOTTED}{WS}*+:{WS}*+([\s\S]++)$", 1)
        items = T.empty_to_null(F.filter(T.arguments(selected), lambda a: T.starts(a, f"^{DOTTED}$")))
        several = F.transform(
            F.filter(T.arguments(rest), lambda a: T.starts(a, f"^{DOTTED}(?:{WS}++as{WS}++{NAME})?$")),
            lambda a: S.import_row(S.null(), F.regexp_extract(a, f"^({DOTTED})", 1)),
        )
        return F.when(selected.isNotNull(), F.array(S.import_row(S.null(), source, items))).otherwise(several)

    return F.flatten(F.transform(F.filter(_with_modules(lines), lambda d: T.starts(d.line, IMPORT)), one))


def parameters(group: Column) -> Column:
    """Positional, typed and keyword parameters; a type is kept if it is a plain name."""
    def one(arg: Column) -> Column:
        return F.when(
            T.starts(arg, PARAM),
            S.parameter_row(F.regexp_extract(arg, PARAM, 1), T.pick(T.trimmed(F.regexp_extract(arg, PARAM, 2)), f"^({NAME})$", 1)),
        )

    # The semicolon before keyword parameters separates like a comma.
    listed = T.find(T.inside(group), f"(?:[^,;{T.BRACKETS}]++|{T.GROUP})++")
    return T.compact(F.transform(F.transform(listed, T.trimmed), one))


def _callable(d: Column, pattern: str, origin: str, doc: bool = True, prefix: str = "") -> Column:
    name = F.regexp_extract(d["line"], pattern, 1)
    return S.function_row(
        F.concat(F.lit(prefix), name) if prefix else name,
        T.empty_to_null(parameters(F.regexp_extract(d["line"], pattern, 2))),
        d["doc"] if doc else S.null(),
        origin,
    )


def _function(d: Column, origin: str) -> Column:
    line = d["line"]
    return (
        F.when(T.starts(line, FUNCTION), _callable(d, FUNCTION, origin))
        .when(T.starts(line, SHORT), _callable(d, SHORT, origin, doc=False))
        .when(T.starts(line, MACRO), _callable(d, MACRO, origin, prefix="@"))
    )


def _is_function(line: Column) -> Column:
    return T.starts(line, FUNCTION) | T.starts(line, SHORT) | T.starts(line, MACRO)


def nested(lines: Column) -> Column:
    """Functions, short forms and macros anywhere inside a function."""
    # Every inner line that may start a definition, with the brackets that follow it.
    piece = rf"(?:{T.B_OPEN}(?:function|macro){WS}++{NAME}{T.PAREN}|{NAME}{T.PAREN}[^\n{T.BRACKETS}=]*+=(?![=>]))"
    holders = F.filter(lines, lambda x: F.contains(x, F.lit(f"{T.B_OPEN}function")) & ~T.starts(x, SHORT))

    def tops(x: Column) -> Column:
        """Outermost functions of a line, which may be a module, a struct or a block."""
        flat = F.translate(x, T.LINE, "\n")
        block = rf"{T.B_OPEN}function\b(?:[^{T.BRACKETS}]++|{T.GROUP})*+{T.B_CLOSE}"
        return T.find(flat, block)

    def inner(block: Column) -> Column:
        rest = T.revealed(F.regexp_replace(block, rf"^{T.B_OPEN}function[^\n]*+", ""))
        before = r"(?<=[\n;])[ \t]*+"
        found = T.find(rest, f"{before}{piece}")
        return F.transform(
            found,
            lambda p: _function(
                F.struct(T.trimmed(F.translate(p, "\n", T.LINE)).alias("line"), S.null().alias("doc")), "nested"
            ),
        )

    return T.compact(F.flatten(F.transform(F.flatten(F.transform(holders, tops)), inner)))


def functions(lines: Column) -> Column:
    top = F.transform(
        F.filter(documented(lines), lambda d: _is_function(d["line"])), lambda d: _function(d, "top")
    )
    held = F.transform(
        F.filter(module_lines(lines), lambda d: T.starts(d["line"], FUNCTION) | T.starts(d["line"], SHORT)),
        lambda d: _function(d, "module"),
    )
    return F.concat(top, held, nested(lines))


def classes(lines: Column) -> Column:
    def one(d: Column) -> Column:
        base = T.pick(d["line"], STRUCT, 2)

        def row(m: Column) -> Column:
            methods = F.transform(
                F.filter(m, lambda x: T.starts(x, SHORT)),
                lambda x: S.method_row(
                    F.regexp_extract(x, SHORT, 1),
                    T.empty_to_null(parameters(F.regexp_extract(x, SHORT, 2))),
                    S.null(),
                ),
            )
            fields = F.transform(
                F.filter(m, lambda x: T.starts(x, FIELD)),
                lambda x: S.attribute_row(
                    F.regexp_extract(x, FIELD, 1), T.pick(T.trimmed(F.regexp_extract(x, FIELD, 2)), f"^({NAME})$", 1)
                ),
            )
            return S.class_row(
                F.regexp_extract(d["line"], STRUCT, 1),
                F.when(base.isNotNull(), F.array(S.base_row(base))),
                T.empty_to_null(methods),
                T.empty_to_null(fields),
                d["doc"],
            )

        return T.let(body(d["line"]), row)

    return F.transform(F.filter(_with_modules(lines), lambda d: T.starts(d["line"], STRUCT)), one)


def variables(lines: Column) -> Column:
    def one(d: Column) -> Column:
        line = d["line"]
        constant = T.starts(line, CONST)
        value = T.trimmed(F.when(constant, F.regexp_extract(line, CONST, 2)).otherwise(F.regexp_extract(line, VARIABLE, 2)))
        alias = F.lit(False)
        for prefix in CONTAINERS:
            alias = alias | F.contains(line, F.lit(prefix))
        literal = T.starts(value, LITERAL) | T.starts(value, f"^{T.STRING}$") | (~constant & value.isin("true", "false"))
        return S.variable_row(
            F.when(constant, F.regexp_extract(line, CONST, 1)).otherwise(F.regexp_extract(line, VARIABLE, 1)),
            F.when(constant, F.lit("constant")).when(alias, F.lit("type_alias")).otherwise(F.lit("external_variable")),
            S.null(),
            T.restore(F.when(literal, value)),
        )

    found = F.filter(_with_modules(lines), lambda d: T.starts(d["line"], CONST) | T.starts(d["line"], VARIABLE))
    return F.transform(found, one)


def enums(lines: Column) -> Column:
    return S.nothing(S.ENUM)


def code_lines(content: Column) -> Column:
    """Content without line comments, each line trimmed."""
    bare = F.transform(
        F.split(T.strip(content), "\n"),
        lambda x: F.struct(F.contains(x, F.lit("#")).alias("noted"), T.strip(F.substring_index(x, "#", 1)).alias("code")),
    )
    kept = F.filter(bare, lambda x: ~x["noted"] | (x["code"] != ""))
    return T.strip(F.array_join(F.transform(kept, lambda x: x["code"]), "\n"))


def triage(content: Column) -> Column:
    """Why a file that failed is beyond recovery: three independent signs."""
    closed = T.nested("(", ")", 64)

    def signs(code: Column) -> Column:
        structs = F.size(F.split(code, "struct", -1)) - 1
        ends = F.size(F.split(code, "end", -1)) - 1
        return F.struct(
            code.rlike(rf"function\s+\w+\s*+\((?!(?:[^()]++|{closed})*+\))").alias("unclosed_function"),
            (F.contains(code, F.lit("struct ")) & (structs > ends)).alias("unclosed_struct"),
            (F.length(code) < 5).alias("too_short"),
        )

    return T.let(code_lines(content), signs)


def recoverable(content: Column) -> Column:
    return T.let(triage(content), lambda t: ~(t["unclosed_function"] | t["unclosed_struct"] | t["too_short"]))


# The line patterns of the fallback extraction.
FALLBACK_IMPORT = [
    r"(?m)^\s*using\s+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)",
    r"(?m)^\s*import\s+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)",
]
FALLBACK_FUNCTION = [
    r"(?m)^\s*function\s+([A-Za-z_][A-Za-z0-9_!]*)\s*\(",
    r"(?m)^\s*([A-Za-z_][A-Za-z0-9_!]*)\s*\([^)]*\)\s*=",
]
FALLBACK_STRUCT = [r"(?m)^\s*(?:mutable\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)"]
FALLBACK_CONST = [r"(?m)^\s*const\s+([A-Za-z_][A-Za-z0-9_]*)\s*="]
FALLBACK_MACRO = [r"(?m)^\s*macro\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("]
FALLBACK = {
    "import": FALLBACK_IMPORT,
    "function": FALLBACK_FUNCTION,
    "struct": FALLBACK_STRUCT,
    "constant": FALLBACK_CONST,
    "macro": FALLBACK_MACRO,
}


def fallback_names(content: Column, kind: str) -> Column:
    """Names found by the fallback patterns of one kind, in pattern then text order."""
    found = F.concat(*[T.find(content, p, 1) for p in FALLBACK[kind]])
    return F.transform(found, lambda n: F.concat(F.lit("@"), n)) if kind == "macro" else found


def _unseen(names: Column, primary: Column, key: str) -> Column:
    return T.let(
        F.transform(primary, lambda x: x[key]),
        lambda seen: F.filter(names, lambda n: ~F.coalesce(F.array_contains(seen, n), F.lit(False))),
    )


def merged(content: Column, kind: str, primary: Column) -> Column:
    """Primary elements followed by the fallback ones whose key is not among them."""
    if kind == "imports":
        names = _unseen(fallback_names(content, "import"), primary, "source")
        return F.concat(primary, F.transform(names, lambda n: S.import_row(S.null(), n)))
    if kind == "functions":
        names = F.concat(fallback_names(content, "function"), fallback_names(content, "macro"))
        row = lambda n: S.function_row(n, S.null(f"array<{S.PARAMETER}>"), S.null(), "fallback")
        return F.concat(primary, F.transform(_unseen(names, primary, "name"), row))
    if kind == "classes":
        names = _unseen(fallback_names(content, "struct"), primary, "name")
        empty = [S.null(f"array<{t}>") for t in (S.BASE, S.METHOD, S.ATTRIBUTE)]
        return F.concat(primary, F.transform(names, lambda n: S.class_row(n, *empty, S.null())))
    if kind == "variables":
        names = _unseen(fallback_names(content, "constant"), primary, "name")
        return F.concat(
            primary, F.transform(names, lambda n: S.variable_row(n, F.lit("constant"), S.null(), S.null()))
        )
    return primary
