"""Display text: money, percent, months, quantities and unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.cells import strip

# ---- fixed values: currency symbols and unit names -------------------------------------------------
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}
UNIT_NAMES = {
    "hrs": "hour", "hours": "hour", "hour": "hour",
    "vcpu-hours": "vCPU-hour", "gb-hours": "GB-hour", "dpu-hours": "DPU-hour",
    "gb-mo": "GB-month", "gb-month": "GB-month", "gb-months": "GB-month",
    "requests": "request", "each": "unit", "quantity": "unit", "count": "unit",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _signed(amount: Column, digits: Column, currency: Column) -> Column:
    sign = F.when(amount < 0, "-").otherwise("")
    symbol = _lookup(SYMBOLS, currency)
    suffix = F.when(F.coalesce(currency, F.lit("")) != "", F.concat(F.lit(" "), currency)).otherwise("")
    return F.when(symbol.isNotNull(), F.concat(sign, symbol, digits)).otherwise(F.concat(sign, digits, suffix))


def money(amount: Column, currency: Column) -> Column:
    return _signed(amount, F.format_number(F.abs(amount), 2), currency)


def percent(ratio: Column) -> Column:
    """One place, halves away from zero (the only place that is not half-even)."""
    return F.concat(F.round(ratio.cast("decimal(20,6)") * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")


def unit_name(unit: Column) -> Column:
    return F.coalesce(_lookup(UNIT_NAMES, F.lower(strip(unit))), unit)


def quantity(amount: Column, unit: Column) -> Column:
    whole = amount == F.floor(amount)
    digits = F.when(whole, F.format_number(amount, 0)).otherwise(F.format_number(amount, 2))
    return F.concat(digits, F.lit(" "), unit_name(unit), F.when(amount == 1, "").otherwise("s"))


def unit_rate(amount: Column, currency: Column, unit: Column) -> Column:
    """Two to six places, as many as the price has: two would hide most unit prices."""
    digits = F.regexp_replace(F.format_number(F.abs(amount), 6), r"(\.\d\d\d*?)0+$", "$1")
    return F.concat(_signed(amount, digits, currency), F.lit(" per "), unit_name(unit))
