"""Comment removal.

Line comments, markup comments and blank lines are regular on the whole text, so
they are plain ``regexp_replace`` calls. Only texts that really contain a block
comment or a triple quote go through the line automaton. Texts are handled with
a line feed in front of every line; the patterns begin at it or at the comment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import C_EXTENSIONS, HASH_EXTENSIONS, MARKUP_EXTENSIONS
from corpusloom.functions.automaton import rewrite
from corpusloom.functions.paths import extension
from corpusloom.functions.text import WS, WS_LINE, after_first, is_blank, preceded

# A line that holds only a comment goes with its line feed, else from the mark on.
_C_LINE = rf"(?=[\n/])(?:\n[{WS_LINE}]*+)?//[^\n]*"
_HASH_LINE = rf"(?=[\n#])(?:(\n[{WS_LINE}]*+#![^\n]*)|(?:\n[{WS_LINE}]*+)?#[^\n]*)"
_MARKUP_LINE = r"\n[^\n]*?<!--[^\n]*"
# Nothing but blanks; blank lines at the start, with the first line feed; a run of
# blank lines elsewhere, of which one stays.
_SPARE_BLANKS = rf"\A[{WS}]*+\z|\A[{WS}]*\n|(\n)[{WS}]*(?:\z|(\n))"

_INLINE_BLOCK = r"(?s)/\*.*?\*/"
_BLOCK_LINE = r"\n[^\n]*?(?:/\*|\*/)[^\n]*"
_QUOTES = ('"""', "'''")
_QUOTE_LINE = r"\n[^\n]*?(?:\"\"\"|''')[^\n]*"


def _unless_blank(line: Column) -> Column:
    return F.when(~is_blank(line), F.concat(F.lit("\n"), line))


def _without_inline_blocks(line: Column) -> Column:
    """Without ``/* ... */`` on one line. Nothing can close after the last mark,
    so the search stops there and stays linear on lines of many opening marks."""
    tail = F.substring_index(line, "*/", -1)
    head = F.substr(line, F.lit(1), F.length(line) - F.length(tail))
    return F.concat(F.regexp_replace(head, _INLINE_BLOCK, ""), tail)


def _markup(text: Column) -> Column:
    """Lines are on their own here: one state, and only lines with a mark change."""

    def without_comments(line: Column, state: Column) -> Column:
        whole = line.rlike(rf"\A[{WS_LINE}]*<!--") & line.rlike(rf"-->[{WS_LINE}]*\z")
        # Nothing can close after the last mark, so the search stops there.
        tail = F.substring_index(line, "-->", -1)
        head = F.substr(line, F.lit(1), F.length(line) - F.length(tail))
        bare = F.concat(F.regexp_replace(head, r"(?s)<!--.*?-->", ""), tail)
        return F.when(~whole, F.concat(F.lit("\n"), bare))

    return rewrite(text, _MARKUP_LINE, "N", lambda line: F.lit("N"), lambda part, state: part, without_comments)


def _c_after(line: Column) -> Column:
    """State after a line read outside a block comment."""
    return F.when(_without_inline_blocks(line).contains("/*"), "B").otherwise("N")


def _c_blocks(text: Column) -> Column:
    """States: N code, B inside a block comment."""

    def effect(line: Column) -> Column:
        closed = F.when(line.contains("*/"), _c_after(after_first(line, "*/"))).otherwise("B")
        return F.concat(_c_after(line), closed)

    def code(line: Column, state: Column) -> Column:
        seen = F.when(state == "N", line).when(line.contains("*/"), after_first(line, "*/"))
        rest = _without_inline_blocks(seen)
        # An opening mark is looked for before '//', also inside a line comment.
        return _unless_blank(
            F.when(rest.contains("/*"), F.substring_index(rest, "/*", 1)).otherwise(
                F.substring_index(rest, "//", 1)
            )
        )

    def between(stretch: Column, state: Column) -> Column:
        return F.when(state == "N", F.regexp_replace(stretch, _C_LINE, ""))

    return rewrite(text, _BLOCK_LINE, "NB", effect, between, code)


def _py_after(line: Column) -> Column:
    """State after a line read outside a docstring: D and S are the two quotes."""
    result = F.lit("N")
    for quote, state in reversed(list(zip(_QUOTES, "DS"))):
        lone = ~after_first(line, quote).contains(quote)
        result = F.when(line.contains(quote), F.when(lone, state).otherwise("N")).otherwise(result)
    return result


def _py_docstrings(text: Column) -> Column:
    """States: N code, D and S inside a docstring with double or single quotes."""
    double, single = _QUOTES

    def effect(line: Column) -> Column:
        from_d = F.when(line.contains(double), _py_after(after_first(line, double))).otherwise("D")
        from_s = F.when(line.contains(single), _py_after(after_first(line, single))).otherwise("S")
        return F.concat(_py_after(line), from_d, from_s)

    def without_docstring(line: Column) -> Column:
        result = line
        for quote in reversed(_QUOTES):
            rest = after_first(line, quote)
            tail = F.when(rest.contains(quote), after_first(rest, quote)).otherwise("")
            result = F.when(
                line.contains(quote), F.concat(F.substring_index(line, quote, 1), tail)
            ).otherwise(result)
        return result

    def code(line: Column, state: Column) -> Column:
        seen = (
            F.when(state == "N", line)
            .when((state == "D") & line.contains(double), after_first(line, double))
            .when((state == "S") & line.contains(single), after_first(line, single))
        )
        rest = without_docstring(seen)
        return _unless_blank(
            F.when(rest.rlike(rf"\A[{WS_LINE}]*#!"), rest).otherwise(
                F.substring_index(rest, "#", 1)
            )
        )

    def between(stretch: Column, state: Column) -> Column:
        return F.when(state == "N", F.regexp_replace(stretch, _HASH_LINE, "$1"))

    return rewrite(text, _QUOTE_LINE, "NDS", effect, between, code)


def strip_comments(content: Column, path: Column) -> Column:
    """Content without comments and spare blank lines, by file extension."""
    ext = extension(path)
    text = preceded(content)
    triple = content.contains(_QUOTES[0]) | content.contains(_QUOTES[1])
    bare = (
        F.when(
            ext.isin(C_EXTENSIONS),
            F.when(content.contains("/*"), _c_blocks(text)).otherwise(
                F.regexp_replace(text, _C_LINE, "")
            ),
        )
        .when(
            ext.isin(HASH_EXTENSIONS),
            F.when((ext == ".py") & triple, _py_docstrings(text)).otherwise(
                F.regexp_replace(text, _HASH_LINE, "$1")
            ),
        )
        .when(
            ext.isin(MARKUP_EXTENSIONS) & content.contains("<!--"),
            _markup(text),
        )
        .otherwise(text)
    )
    return F.regexp_replace(bare, _SPARE_BLANKS, "$1$2")
