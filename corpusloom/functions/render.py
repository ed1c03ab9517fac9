"""Text blocks for one file and lines for the tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import DIR_ICON, FILE_ICON
from corpusloom.functions.paths import language
from corpusloom.functions.text import cdata_escape, size_kb, token_estimate


Counter = Callable[[Column], Column]


def _closed(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def render_xml(path: Column, content: Column, counter: Counter = token_estimate) -> Column:
    return F.concat(
        F.lit('<file path="'), path,
        F.lit('" size="'), size_kb(F.octet_length(content)),
        F.lit(' KB" tokens="'), counter(content).cast("string"),
        F.lit('">\n<![CDATA[\n'),
        _closed(cdata_escape(content)),
        F.lit("]]>\n</file>\n\n"),
    )


def render_markdown(path: Column, content: Column, counter: Counter = token_estimate) -> Column:
    return F.concat(
        F.lit("## File: "), path,
        F.lit(" (Size: "), size_kb(F.octet_length(content)),
        F.lit(" KB | Tokens: "), counter(content).cast("string"),
        F.lit(")\n```"), language(path), F.lit("\n"),
        _closed(content),
        F.lit("```\n\n"),
    )


def render(
    path: Column, content: Column, fmt: str = "markdown", counter: Counter = token_estimate
) -> Column:
    """XML if ``fmt`` says so in any case, else Markdown. ``counter`` gives the tokens
    of a text."""
    return (render_xml if fmt.lower() == "xml" else render_markdown)(path, content, counter)


def tree_line(name: Column, depth: Column, is_dir: Column) -> Column:
    return F.concat(
        F.repeat(F.lit("  "), depth),
        F.when(is_dir, F.concat(F.lit(DIR_ICON + " "), name, F.lit("/\n"))).otherwise(
            F.concat(F.lit(FILE_ICON + " "), name, F.lit("\n"))
        ),
    )
