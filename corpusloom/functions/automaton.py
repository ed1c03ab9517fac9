"""Small finite automata over the lines of one text, inside the row.

Only lines that hold a marker can change the state, so a text is cut into its
marker lines and the stretches between them. A marker line is described by its
effect: one letter per state, naming the state it leads to. Following the
effects in order gives the state before every marker line, and so that of the
stretch before it. Nothing leaves the row, so no shuffle is needed, and the cost
is one regex pass plus a step per marker line.

Texts come in the form of ``preceded``: a line feed in front of every line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

# Letters gathered before they move to the finished list; keeps appending cheap.
_BLOCK = 1024


def states_before(effects: Column, states: str) -> Column:
    """Array of the state letter before each effect; the first letter of
    ``states`` is the start."""
    start = F.struct(
        F.lit(states[0]).alias("now"),
        F.lit("").alias("open"),
        F.array().cast("array<string>").alias("done"),
    )

    def step(acc: Column, effect: Column) -> Column:
        now = F.substring(effect, len(states), 1)
        for i, letter in reversed(list(enumerate(states[:-1], 1))):
            now = F.when(acc["now"] == letter, F.substring(effect, i, 1)).otherwise(now)
        full = F.octet_length(acc["open"]) >= _BLOCK
        return F.struct(
            now.alias("now"),
            F.when(full, acc["now"]).otherwise(F.concat(acc["open"], acc["now"])).alias("open"),
            F.when(full, F.array_append(acc["done"], acc["open"]))
            .otherwise(acc["done"])
            .alias("done"),
        )

    letters = F.aggregate(
        effects,
        start,
        step,
        lambda acc: F.array_join(F.array_append(acc["done"], acc["open"]), ""),
    )
    return F.split(letters, "")


def rewrite(
    text: Column,
    marker: str,
    states: str,
    effect: Callable[[Column], Column],
    stretch: Callable[[Column, Column], Column],
    line: Callable[[Column, Column], Column],
) -> Column:
    """Rewrite ``text``, whose marker lines are those matched by ``marker`` (a
    regex that begins with the line feed and takes the whole line).

    ``effect(line)`` describes a marker line; ``stretch(text, state)`` and
    ``line(line, state)`` give the new text of the other lines and of a marker
    line. Lines are handed over without their line feed; null drops them.
    """

    def bare(m: Column) -> Column:
        return F.substr(m, F.lit(2))

    def rejoin(markers: Column, before: Column) -> Column:
        between = F.zip_with(F.split(text, marker), before, stretch)
        # The last entry of ``markers`` is '' and closes the last stretch.
        lines = F.zip_with(
            markers, before, lambda m, state: F.when(m != "", line(bare(m), state))
        )
        empty = F.lit("")
        return F.array_join(
            F.zip_with(
                between,
                lines,
                lambda a, b: F.concat(F.coalesce(a, empty), F.coalesce(b, empty)),
            ),
            "",
        )

    return let(
        F.array_append(F.regexp_extract_all(text, F.lit(marker), F.lit(0)), F.lit("")),
        lambda markers: let(
            states_before(F.transform(markers, lambda m: effect(bare(m))), states),
            lambda before: rejoin(markers, before),
        ),
    )
