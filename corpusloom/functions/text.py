"""Line splitting, blanks, lengths and number formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as the inside of a regex character class.
WS = (
    r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
# The same without the line feed, for patterns that must stay on one line.
WS_LINE = WS.replace(r"\n", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def after_first(text: Column, marker: str) -> Column:
    """What follows the first ``marker``; only call it where the marker occurs."""
    return F.substr(text, F.instr(text, marker) + F.lit(len(marker)))


def _without_ends(content: Column) -> Column:
    """Content without carriage returns before line ends and without the last
    line feed."""
    clean = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    ended = content.endswith("\n") | content.endswith("\r")
    return F.when(ended, F.substr(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean)


def preceded(content: Column) -> Column:
    """Content with a line feed in front of every line instead of behind it;
    carriage returns before line ends are gone. Empty content has no line."""
    return F.when(content == "", "").otherwise(F.concat(F.lit("\n"), _without_ends(content)))


def lines(content: Column) -> Column:
    """Lines without their ends; a final line feed opens no further line."""
    return F.when(content == "", F.array().cast("array<string>")).otherwise(
        F.split(_without_ends(content), "\n")
    )


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.shiftright(F.octet_length(text).cast("bigint"), 2)


def _half_even(units: Column, divisor: int) -> Column:
    """``units / divisor`` as an integer, ties to even (``units`` >= 0)."""
    whole = F.call_function("div", units, F.lit(divisor))
    rest = units % divisor
    half = divisor // 2
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return whole + up.cast("bigint")


def _two_decimals(hundredths: Column) -> Column:
    return F.concat(
        F.call_function("div", hundredths, F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
    )


def size_kb(n_bytes: Column) -> Column:
    """Bytes / 1024 with two decimals. Integer arithmetic keeps ties exact."""
    return _two_decimals(_half_even(n_bytes.cast("bigint") * 100, 1024))


def compact_number(n: Column) -> Column:
    """``950``, ``1.2k``, ``3.45m``. Decimal ties fall to the side on which the
    binary quotient lies, and to even where the quotient is exact."""
    n = n.cast("bigint")

    def digits(unit: int, step: int) -> Column:
        whole = F.call_function("div", n, F.lit(step))
        rest = n % step
        half = step // 2
        quotient = n.cast("double") / F.lit(float(unit))

        def tie_up(bits: int) -> Column:
            # quotient * 2**bits is a whole number, so both sides are exact.
            scaled = (quotient * F.lit(float(2**bits))).cast("bigint").cast("decimal(38,0)")
            left = scaled * F.lit(unit).cast("decimal(10,0)")
            right = n.cast("decimal(20,0)") * F.lit(2**bits).cast("decimal(18,0)")
            return (left > right) | ((left == right) & (whole % 2 == 1))

        tie = (
            F.when(quotient < 1024.0, tie_up(52))
            .when(quotient < 1048576.0, tie_up(42))
            .otherwise(tie_up(32))
        )
        up = F.when(rest == half, tie).otherwise(rest > half)
        return whole + up.cast("bigint")

    tenths = digits(1_000, 100)
    return (
        F.when(n < 1_000, n.cast("string"))
        .when(
            n < 1_000_000,
            F.concat(
                F.call_function("div", tenths, F.lit(10)).cast("string"),
                F.lit("."),
                (tenths % 10).cast("string"),
                F.lit("k"),
            ),
        )
        .otherwise(F.concat(_two_decimals(digits(1_000_000, 10_000)), F.lit("m")))
    )


def cdata_escape(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def cdata_restore(text: Column) -> Column:
    return F.replace(text, F.lit("]]]]><![CDATA[>"), F.lit("]]>"))
