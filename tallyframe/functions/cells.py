"""Column cleaning over raw cells: money, quantities, dates, headers, labels. All JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.schema import (
    COST, MAX_ABS_COST, MAX_ABS_QUANTITY, QUANTITY,
)

# ---- fixed values: whitespace, number, date and header patterns --------------------------------
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
PLAIN_NUMBER = r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"
SLASH_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
HEADER_CURRENCY = r"\s*\(\s*([$€£¥]|[A-Z]{3})\s*\)\s*$"
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CAMEL_BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
UNALLOCATED_LABEL = r"(?i)^(no\b.*|others?|\(none\)|none|untagged|unknown|n/a|not tagged)$"
TRUE_WORDS = ["true", "yes", "y", "1", "t"]
BLANK_LABEL = "(blank)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


#: Stands for accounting parentheses while a number is being read. Accepted text holds no NUL.
_WRAPPED = "\x00"
_GROUP_COMMA = rf",(?<=^{_WRAPPED}?[-+]?\d{{1,3}}(?:,\d{{3}}){{0,40}},)(?=\d{{3}}(?:,\d{{3}})*(?:\.\d+)?$)"


def _ungrouped(text: Column, decimal_comma: Column) -> Column:
    """Decimal comma to point where that is the file's convention, then thousands separators away."""
    pointed = F.when(decimal_comma, F.regexp_replace(text, rf"^({_WRAPPED}?[-+]?\d+),(\d+)$", "$1.$2")).otherwise(text)
    return F.regexp_replace(pointed, _GROUP_COMMA, "")


def _cell(text: Column, valid: str, target, limit) -> Column:
    """struct(status, value) of normalised number text. Written so `text` is repeated few times."""
    value = F.when(text.rlike(valid), F.translate(text, _WRAPPED, "").try_cast(target))
    in_range = F.abs(value) <= F.lit(limit).cast("decimal(38,0)")
    status = (F.when(text == "", "empty").when(~text.rlike(valid), "invalid")
              .when(F.coalesce(in_range, F.lit(False)), "ok").otherwise("out_of_range"))
    signed = F.when(text.startswith(_WRAPPED), -value).otherwise(value)
    return F.struct(status.alias("status"), F.when(in_range, signed).cast(target).alias("value"))


def _bool(c: Column | bool) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def money_text(raw: Column, decimal_comma: Column | bool = False) -> Column:
    """A money cell brought to plain number text, accounting parentheses as a leading marker."""
    marked = F.regexp_replace(strip(raw), r"(?s)^\((.*)\)$", f"{_WRAPPED}$1")
    bare = F.regexp_replace(marked, rf"^({_WRAPPED}?)\s*([-+]?)[$€£¥]", "$1$2")
    return _ungrouped(F.regexp_replace(strip(bare), rf"^({_WRAPPED}?)\s+", "$1"), _bool(decimal_comma))


def money_cell(text: Column) -> Column:
    """struct(status, value) of money text. A minus inside parentheses is not a number anyone meant."""
    valid = rf"^(?:{_WRAPPED}(?!-[^eE]*[1-9]))?" + PLAIN_NUMBER.removeprefix("^")
    return _cell(text, valid, COST, MAX_ABS_COST)


def money(raw: Column, decimal_comma: Column | bool = False) -> Column:
    """struct(status, value): ok / empty / invalid / out_of_range. Never coerces to zero.

    Accounting parentheses negate. One currency symbol may stand before the number or after its sign.
    """
    return money_cell(money_text(raw, decimal_comma))


def quantity_text(raw: Column, decimal_comma: Column | bool = False) -> Column:
    return _ungrouped(strip(raw), _bool(decimal_comma))


def quantity_cell(text: Column) -> Column:
    return _cell(text, PLAIN_NUMBER, QUANTITY, MAX_ABS_QUANTITY)


def quantity(raw: Column, decimal_comma: Column | bool = False) -> Column:
    """As money, without currency signs or parentheses, and with headroom for byte-hours."""
    return quantity_cell(quantity_text(raw, decimal_comma))


_DAY = r"^(?!0000)\d{4}-\d{2}-\d{2}$"


def day_text(trimmed: Column, slash_order: Column | str = "mdy") -> Column:
    """Date text as yyyy-MM-dd, or NULL where it has no known form. The plain form skips the rewriting."""
    order = slash_order if isinstance(slash_order, Column) else F.lit(slash_order)
    time = r"[T ][0-9:.+\-Z]*"
    day = F.regexp_replace(trimmed, rf"^(\d{{4}}-\d{{2}}-\d{{2}}){time}$", "$1")
    month = F.regexp_replace(day, rf"^(\d{{4}}-\d{{2}})(?:{time})?$", "$1-01")
    padded = F.regexp_replace(F.regexp_replace(month, r"^(\d)/", "0$1/"), r"^(\d\d)/(\d)/", "$1/0$2/")
    text = F.regexp_replace(padded, F.lit(r"^(\d\d)/(\d\d)/(\d{4})$"),
                            F.when(order == "mdy", "$3-$1-$2").otherwise("$3-$2-$1"))
    return F.when(trimmed.rlike(_DAY), trimmed).otherwise(F.nullif(F.regexp_extract(text, _DAY, 0), F.lit("")))


def to_day(raw: Column, slash_order: Column | str = "mdy") -> Column:
    """ISO dates with optional day and time, slash dates in a known order; impossible ones are NULL."""
    return day_text(strip(raw), slash_order).try_cast("date")


def slash_first(raw: Column) -> Column:
    return F.regexp_extract(strip(raw), SLASH_DATE, 1).try_cast("int")


def slash_second(raw: Column) -> Column:
    return F.regexp_extract(strip(raw), SLASH_DATE, 2).try_cast("int")


def slash_order_from(first_over_12: Column, second_over_12: Column, any_slash: Column) -> tuple[Column, Column]:
    """(order, assumed) for a column already summarised to three booleans."""
    order = F.when(first_over_12, "dmy").otherwise("mdy")
    assumed = any_slash & ~first_over_12 & ~second_over_12
    return order, assumed


def header_currency(header: Column) -> Column:
    marker = F.regexp_extract(header, HEADER_CURRENCY, 1)
    known = F.create_map(*[F.lit(x) for kv in CURRENCY_SYMBOLS.items() for x in kv])
    return F.when(marker != "", F.coalesce(F.try_element_at(known, marker), marker))


def header_label(header: Column) -> Column:
    return strip(F.regexp_replace(header, HEADER_CURRENCY, ""))


def clean_label(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"[\x00-\x1f\x7f]", " "))


def is_unallocated_label(label: Column) -> Column:
    return strip(label).rlike(UNALLOCATED_LABEL)


def normalized_header(header: Column) -> Column:
    """Spaced lower-case form of a header; slash-qualified names are kept whole."""
    base = header_label(header)
    spaced = F.regexp_replace(strip(F.translate(base, "_", " ")), CAMEL_BOUNDARY, " ")
    return F.when(base.contains("/"), F.lower(base)).otherwise(F.lower(F.regexp_replace(spaced, r"(?U)\s+", " ")))


def is_true(raw: Column) -> Column:
    return F.lower(strip(raw)).isin(TRUE_WORDS)


def is_total_label(raw: Column) -> Column:
    v = F.lower(strip(raw))
    return (v == "total") | v.endswith(" total")
