r"""Text expressions shared by all extractors.

Source text is prepared in four steps, each one expression over the ``content``
column, so that extraction never shuffles and never leaves the JVM:

1. ``protect``: strings and comments are found by one token pattern, and every
   character inside them that has a meaning for the later patterns is swapped for a
   stand-in (a Unicode noncharacter, which valid text never holds).
2. ``shallow``: brackets below the depth that patterns can pair are hidden like the
   characters of strings, found by one fold over the brackets; ``deeper`` shows them again
   where an extractor descends. Nesting of any depth is parsed with patterns of a few levels.
3. ``bracket_state``: the remaining brackets are reduced pairwise, in as many rounds as
   the text is deep. Files that do not reduce to nothing are quarantined with a reason.
4. ``logical_lines``: text is cut at line ends outside brackets.

``restore`` swaps the stand-ins back, so every emitted value is the original text.

Patterns that repeat groups use possessive quantifiers: Java matches those in a loop
instead of by recursion, so long files cannot overflow the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of brackets that patterns pair; what lies deeper is hidden from them.
VISIBLE = 12

SPECIAL = "\n(){}[],;:=<>\"'`#*/"
STAND_IN = "".join(chr(0xFDD0 + i) for i in range(len(SPECIAL)))
S_OPEN, S_CLOSE = "\ufde8", "\ufde9"  # around a string token
C_OPEN, C_CLOSE = "\ufdea", "\ufdeb"  # around a comment token
B_OPEN, B_CLOSE = "\ufdec", "\ufded"  # around a keyword block (``function .. end``)
LINE = "\ufdee"  # a line end inside brackets
A_OPEN, A_CLOSE = "\ufde4", "\ufde5"  # an angle bracket too deep for the patterns

# Brackets below the visible levels, in the order of ``_ROUND`` and of the block marks.
_ROUND = "()[]{}"
HIDDEN = "\ufde3\ufde6\ufde7\ufdef\U0001fffe\U0001ffff"
HIDDEN_BLOCK = "\ufffe\uffff"

STRING = f"{S_OPEN}[^{S_CLOSE}]*+{S_CLOSE}"
COMMENT = f"{C_OPEN}[^{C_CLOSE}]*+{C_CLOSE}"

_BRACKET_IN = rf"(\[{{{B_OPEN}"
_BRACKET_OUT = rf")\]}}{B_CLOSE}"
BRACKETS = _BRACKET_IN + _BRACKET_OUT


def nested(opening: str, closing: str, depth: int = VISIBLE) -> str:
    """Pattern of one balanced group whose brackets are any of the two classes."""
    pattern = f"[{opening}][^{opening}{closing}]*+[{closing}]"
    for _ in range(depth):
        pattern = f"[{opening}](?:[^{opening}{closing}]++|{pattern})*+[{closing}]"
    return pattern


GROUP = nested(_BRACKET_IN, _BRACKET_OUT)
_INNER = f"(?:[^{BRACKETS}]++|{GROUP})*+"
PAREN = rf"\({_INNER}\)"
BRACE = rf"\{{{_INNER}\}}"
SQUARE = rf"\[{_INNER}\]"
ARGUMENT = f"(?:[^,{BRACKETS}]++|{GROUP})++"

# Letters of an identifier: ASCII plus everything below the stand-ins.
WORD = "A-Za-z0-9_\u0080-\ufdcf"
IDENT = f"[A-Za-z_\u0080-\ufdcf][{WORD}]*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an expression so that it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def no_empty(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def empty_to_null(items: Column) -> Column:
    return let(items, lambda x: F.when(F.size(x) > 0, x))


def compact(items: Column) -> Column:
    """Drop NULL elements."""
    return F.filter(items, lambda x: x.isNotNull())


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def starts(text: Column, pattern: str) -> Column:
    """Does a pattern anchored at the start match?

    The empty alternative ends the search at the first character; a plain regular
    expression test would retry at every position of the text before it gives up.
    """
    return F.regexp_extract(text, f"(?:{pattern})|^", 0) != ""


def pick(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of one group, NULL when there is none or it is empty."""
    return no_empty(F.regexp_extract(text, pattern, group))


def protect(content: Column, token: str, is_string: Callable[[Column], Column], is_comment: Callable[[Column], Column], *, keep_comments: bool) -> Column:
    """Swap the special characters of strings and comments for stand-ins."""
    clean = F.regexp_replace(content, "\r\n?", "\n")

    def hide(t: Column) -> Column:
        return F.translate(t, SPECIAL, STAND_IN)

    def segment(t: Column) -> Column:
        comment = F.concat(F.lit(C_OPEN), hide(t), F.lit(C_CLOSE)) if keep_comments else F.lit("")
        return (
            F.when(is_comment(t), comment)
            .when(is_string(t), F.concat(F.lit(S_OPEN), hide(t), F.lit(S_CLOSE)))
            .otherwise(t)
        )

    return F.array_join(F.transform(find(clean, token), segment), "")


def restore(text: Column) -> Column:
    """Original text of a prepared piece."""
    marks = S_OPEN + S_CLOSE + C_OPEN + C_CLOSE + B_OPEN + B_CLOSE + HIDDEN_BLOCK
    return F.translate(text, STAND_IN + LINE + A_OPEN + A_CLOSE + HIDDEN + marks, SPECIAL + "\n<>" + _ROUND)


def trimmed(text: Column) -> Column:
    """Strip blanks, tabs and line ends on both sides."""
    return F.regexp_replace(text, f"^[ \t\r\n{LINE}]++|[ \t\r\n{LINE}]++$", "")


def source_text(text: Column) -> Column:
    return restore(trimmed(text))


_PAIR = rf"\(\)|\[\]|\{{\}}|{B_OPEN}{B_CLOSE}"


def _skeleton(prepared: Column) -> Column:
    return F.regexp_replace(prepared, f"[^{BRACKETS}]++", "")


def _reduced(skeleton: Column, rounds: Column) -> Column:
    """What is left of the brackets after so many rounds, each of which drops the innermost pairs."""
    def step(acc: Column, _: Column) -> Column:
        # rounds after the last change cost nothing
        once = let(F.regexp_replace(acc["text"], _PAIR, ""), lambda n: F.struct(n.alias("text"), (n != acc["text"]).alias("more")))
        return F.when(acc["more"], once).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), rounds), F.struct(skeleton.alias("text"), (skeleton != "").alias("more")), step)["text"]


def _all_rounds(skeleton: Column) -> Column:
    return F.floor(F.length(skeleton) / 2).cast("int") + 1


def shallow(prepared: Column) -> Column:
    """Hides the brackets below ``VISIBLE`` levels of a text whose brackets all pair up."""
    tokens = f"[{BRACKETS}]|[^{BRACKETS}]++"
    opening, closing = "([{" + B_OPEN, ")]}" + B_CLOSE

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t.isin(*opening), 1).otherwise(0)
        seen = F.when(depth > VISIBLE, F.translate(t, _ROUND + B_OPEN + B_CLOSE, HIDDEN + HIDDEN_BLOCK)).otherwise(t)
        return F.struct(
            F.concat(acc["text"], seen).alias("text"), (depth - F.when(t.isin(*closing), 1).otherwise(0)).alias("depth")
        )

    def hidden(skeleton: Column) -> Column:
        folded = F.aggregate(find(prepared, tokens), F.struct(F.lit("").alias("text"), F.lit(0).alias("depth")), step)["text"]
        deep = _reduced(skeleton, F.lit(VISIBLE)) != ""
        return F.when(deep & (_reduced(skeleton, _all_rounds(skeleton)) == ""), folded).otherwise(prepared)

    # only text with that many openings in all can be deep; most pieces are told by it
    many = f"(?:[{opening.replace('[', chr(92) + '[')}][^{opening.replace('[', chr(92) + '[')}]*+){{{VISIBLE + 1}}}"
    return F.when(prepared.rlike(many), let(_skeleton(prepared), hidden)).otherwise(prepared)


def revealed(text: Column) -> Column:
    return F.translate(text, HIDDEN + HIDDEN_BLOCK, _ROUND + B_OPEN + B_CLOSE)


def deeper(text: Column) -> Column:
    """Text from inside a bracket group: shows the levels that its outer ones had hidden."""
    return F.when(text.rlike(f"[{HIDDEN + HIDDEN_BLOCK}]"), let(revealed(text), shallow)).otherwise(text)


def bracket_state(prepared: Column, stray: str = "") -> Column:
    """NULL when all brackets pair up, else the reason why the text is rejected.

    ``stray`` matches token fragments that only an unterminated string leaves behind.
    """
    rest = let(_skeleton(prepared), lambda k: _reduced(k, _all_rounds(k)))
    reason = F.when(rest != "", F.lit("syntax error: unbalanced brackets"))
    if stray:
        reason = F.when(prepared.rlike(stray), F.lit("syntax error: unterminated string")).otherwise(reason)
    return reason


def logical_lines(prepared: Column, *, separators: str = "\n") -> Column:
    """Pieces between separators, bracket groups kept whole on one line each."""
    pattern = f"(?:[^{separators}{BRACKETS}]++|{GROUP})++"
    return F.transform(find(prepared, pattern), lambda line: F.translate(line, "\n", LINE))


def arguments(inside: Column) -> Column:
    """Comma-separated pieces outside nested brackets, trimmed, blanks dropped."""
    return F.filter(F.transform(find(inside, ARGUMENT), trimmed), lambda a: a != "")


def inside(group: Column) -> Column:
    """Text between the outer brackets of a group."""
    return F.substring(group, F.lit(2), F.length(group) - 2)


def unquote(text: Column, quotes: str = "\"'") -> Column:
    """Strip one pair of equal outer quotes."""
    out = text
    for q in reversed(quotes):
        out = F.when(
            (F.length(text) >= 2) & text.startswith(q) & text.endswith(q), F.substring(text, F.lit(2), F.length(text) - 2)
        ).otherwise(out)
    return out


def unquote_triple(text: Column) -> Column:
    """Strip triple quotes if there are any, else single ones."""
    def is_triple(q: str) -> Column:
        return (F.length(text) >= 6) & text.startswith(q) & text.endswith(q)

    return F.when(is_triple('"""') | is_triple("'''"), F.substring(text, F.lit(4), F.length(text) - 6)).otherwise(
        unquote(text)
    )


def dedent(text: Column) -> Column:
    """Remove the leading blanks that all non-blank lines share."""
    def body(lines: Column) -> Column:
        margins = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.regexp_extract(x, "^[ \t]*", 0))
        return let(
            F.struct(F.array_min(margins).alias("lo"), F.array_max(margins).alias("hi")),
            lambda m: let(
                F.coalesce(
                    F.array_max(
                        F.filter(
                            F.sequence(F.lit(0), F.least(F.length(m.lo), F.length(m.hi))),
                            lambda k: F.substring(m.lo, F.lit(1), k) == F.substring(m.hi, F.lit(1), k),
                        )
                    ),
                    F.lit(0),
                ),
                lambda k: F.array_join(
                    F.transform(
                        lines,
                        lambda x: F.when(F.regexp_replace(x, "[ \t]", "") == "", F.lit("")).otherwise(
                            F.substring(x, k + 1, F.length(x))
                        ),
                    ),
                    "\n",
                ),
            ),
        )

    return let(F.split(text, "\n"), body)


def strip(text: Column) -> Column:
    """Strip white space on both sides."""
    return F.regexp_replace(text, r"^\s++|\s++$", "")


def comment_text(token: Column) -> Column:
    r"""Text of a ``/** .. */`` block without delimiters and leading stars."""
    inner = strip(F.regexp_replace(token, r"^/\*\*|\*/$", ""))
    return no_empty(
        strip(
            F.array_join(
                F.transform(F.split(inner, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^\*", ""))),
                "\n",
            )
        )
    )
