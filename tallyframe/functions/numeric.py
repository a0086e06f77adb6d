"""Exact decimal arithmetic under ANSI mode: half-even rounding, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A monthly amount wide enough for 18 integer digits; its quotient keeps 14 fraction digits.
RATIO_TYPE = "decimal(24,6)"


def cents(amount: Column) -> Column:
    """Half-even to two places, as a narrow decimal."""
    return F.bround(amount, 2).cast("decimal(28,2)")


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole rounded half-even, NULL unless whole > 0 and both fit the type."""
    quotient = part.try_cast(RATIO_TYPE) / F.nullif(whole.try_cast(RATIO_TYPE), F.lit(0).cast(RATIO_TYPE))
    return F.when(whole > 0, F.bround(quotient, places)).cast(f"decimal(20,{places})")


def share(part: Column, whole: Column) -> Column:
    """Four-place share of a whole; zero when the whole is not positive."""
    return F.coalesce(ratio(part, whole), F.lit(0).cast("decimal(20,4)"))


def plain(amount: Column, places: int = 2) -> Column:
    """A decimal as text with a fixed number of places, NULL staying NULL."""
    return F.bround(amount, places).cast(f"decimal(30,{places})").cast("string")


def share_text(value: Column, whole: Column) -> Column:
    """A share as text; the zero of an empty whole prints without places."""
    return F.when(whole > 0, value.cast("string")).otherwise(F.lit("0"))


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
