"""Binding a computed value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once. A lambda re-evaluates every outer expression it mentions for
    each element, and the optimizer inlines a column that is used once or that a filter is pushed
    through, so a bound variable is the only form that stays linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
