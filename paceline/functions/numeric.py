"""Ratios and rounding, over SQL expression text on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _round_text(value: str, digits: int) -> str:
    scale, part, mask, half = 10**digits, 1 << 30, (1 << 30) - 1, 1 << 29
    count = f"floor(a) * {scale}L + shiftright(high, 30)"
    left = f"high & {mask}L"
    beyond = f"(mid & {mask}L) > 0 OR (low & {mask}L) > 0 OR ({count}) % 2 = 1"
    up = f"CASE WHEN ({left}) > {half}L OR (({left}) = {half}L AND ({beyond})) THEN 1 ELSE 0 END"
    # Adding zero turns a rounded -0.0 into 0.0.
    text = f"CASE WHEN v < 0 THEN -1D ELSE 1D END * CAST({count} + {up} AS DOUBLE) / {scale}D + 0D"
    text = _let("high", f"floor(x) * {scale}L + shiftright(mid, 30)", text)
    text = _let("mid", f"floor(y) * {scale}L + shiftright(low, 30)", text)
    text = _let("low", f"floor((y - floor(y)) * {part}D) * {scale}L", text)
    text = _let("y", f"(x - floor(x)) * {part}D", text)
    text = _let("x", f"(a - floor(a)) * {part}D", text)
    text = _let("a", "abs(v)", text)
    return _let("v", f"CAST({value} AS DOUBLE)", text)


def round_exact(value: str, digits: int = 4) -> Column:
    """Round half to even on the exact binary value of a double.

    ``bround`` looks at the shortest decimal text of the double and so takes values
    such as 0.12345 for ties. Here the fraction is cut into three 30-bit parts, exactly, and
    multiplied part by part, so that what is left over can be compared with one half.
    """
    return F.expr(_round_text(value, digits))


def share(part: str, whole: str) -> Column:
    """part / whole, rounded to four digits; 0.0 where whole is zero or missing."""
    ratio = f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D)"
    return F.expr(f"coalesce({_round_text(ratio, 4)}, 0D)")


def missing_share(part: str, whole: str) -> Column:
    """1 - part / whole, rounded to four digits; 0.0 where whole is zero or missing.

    The quotient is taken first: as a double, 1 - 799/800 lies below a tie that 1/800 lies above.
    """
    ratio = f"1D - CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D)"
    return F.expr(f"coalesce({_round_text(ratio, 4)}, 0D)")
