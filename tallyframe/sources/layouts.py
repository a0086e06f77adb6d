"""Layout detection and header mapping, per file row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.cells import (
    clean_label, header_currency, header_label, is_total_label, strip, to_day,
)
from tallyframe.schema import LONG_DIMENSIONS

# ---- fixed values: header names of the long layout, best first -----------------------------------------
LONG_ALIASES: dict[str, list[str]] = {
    "date": ["date", "period", "month", "start date", "usage start date", "bill period", "billing period",
             "time period", "time period start", "period start", "billing period start date", "start",
             "lineitem/usagestartdate", "line_item_usage_start_date", "bill/billingperiodstartdate"],
    "period_end": ["end date", "usage end date", "time period end", "period end", "billing period end date",
                   "lineitem/usageenddate", "line_item_usage_end_date", "bill/billingperiodenddate"],
    "cost": ["cost", "amount", "unblended cost", "unblendedcost", "blended cost", "net cost", "amortized cost",
             "net unblended cost", "net amortized cost", "cost amount", "total cost",
             "lineitem/unblendedcost", "line_item_unblended_cost"],
    "service": ["service", "service name", "product name", "product", "product code",
                "lineitem/productcode", "line_item_product_code"],
    "account": ["linked account name", "account name", "account", "linked account",
                "linked account id", "account id", "usage account id",
                "lineitem/usageaccountid", "line_item_usage_account_id"],
    "region": ["region", "product/region", "product_region"],
    "usage_type": ["usage type", "lineitem/usagetype", "line_item_usage_type"],
    "tag": ["team", "owner", "cost center", "business unit", "resource tags user team",
            "resourcetags/user:team", "resourcetags/user:owner", "resourcetags/user:costcenter"],
    "environment": ["environment", "env", "stage", "resource tags user environment",
                    "resourcetags/user:environment", "resourcetags/user:env"],
    "charge_type": ["charge type", "line item type", "record type",
                    "lineitem/lineitemtype", "line_item_line_item_type"],
    "usage_quantity": ["usage quantity", "usage amount", "quantity",
                       "lineitem/usageamount", "line_item_usage_amount"],
    "usage_unit": ["usage unit", "pricing unit", "lineitem/usageunit", "line_item_usage_unit", "pricing/unit"],
    "currency": ["currency", "currency code", "lineitem/currencycode", "line_item_currency_code"],
    "partial": ["is partial period", "ispartialperiod", "partial period", "partial"],
}
# ---- fixed values: first header cell of the wide layout, first match wins ------------------------------
WIDE_DIMENSIONS = [
    (r"(?i)^service$", "service"),
    (r"(?i)^(linked )?account( name)?$|(?i)^member account$", "account"),
    (r"(?i)^region$", "region"),
    (r"(?i)^usage type( group)?$", "usage_type"),
    (r"(?i)^instance type( family)?$", "instance_type"),
    (r"(?i)^api operation$", "operation"),
    (r"(?i)^charge type$", "charge_type"),
    (r"(?i)^availability zone$", "availability_zone"),
    (r"(?i)^tag\b", "tag"),
    (r"(?i)^cost categor", "cost_category"),
]


def map_headers(spaced: Column, joined: Column) -> Column:
    """struct(field -> column index or NULL): per field the best alias present, leftmost column.

    `spaced`: normalised headers; `joined`: the same with underscores, which some aliases use.
    """
    def index(aliases: list[str]) -> Column:
        found = F.transform(F.array(*map(F.lit, aliases)), lambda a: F.least(
            F.nullif(F.array_position(spaced, a), F.lit(0)), F.nullif(F.array_position(joined, a), F.lit(0))))
        return (F.get(F.filter(found, lambda p: p.isNotNull()), F.lit(0)) - 1).cast("int")

    return F.struct(*[index(names).alias(name) for name, names in LONG_ALIASES.items()])


def present(cols: Column, names: list[str]) -> Column:
    """Names among `names` that the header maps, in the given order."""
    return F.array_compact(F.array(*[F.when(cols[n].isNotNull(), F.lit(n)) for n in names]))


def looks_long(cols: Column) -> Column:
    return cols["date"].isNotNull() & (cols["cost"].isNotNull() | (F.size(present(cols, LONG_DIMENSIONS)) > 0))


def looks_wide(header: Column, first_cells: Column, order: Column) -> Column:
    """At least half of the first cells below the header are dates, and at least one."""
    data = F.filter(first_cells, lambda c: ~is_total_label(c))
    dated = F.size(F.filter(data, lambda c: to_day(c, order).isNotNull()))
    enough = F.greatest(F.lit(1), F.floor(F.size(data) / F.lit(2)).cast("int"))
    return (F.size(header) >= 2) & (F.size(data) > 0) & (dated >= enough)


def wide_dimension(label: Column) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(WIDE_DIMENSIONS):
        out = F.when(label.rlike(pattern), name).otherwise(out)
    return out


def wide_label(header: Column) -> Column:
    return F.coalesce(F.nullif(clean_label(F.get(header, F.lit(0))), F.lit("")), F.lit("Group"))


def wide_columns(header: Column) -> Column:
    """array<struct(idx, label, currency, total)> for every column after the first."""
    return F.filter(
        F.transform(header, lambda h, i: F.struct(
            i.alias("idx"), clean_label(header_label(h)).alias("label"), header_currency(h).alias("currency"),
            F.lower(strip(header_label(h))).startswith("total").alias("total"))),
        lambda c: c["idx"] > 0)


def first_currency(header: Column) -> Column:
    return F.get(F.filter(F.transform(header, header_currency), lambda c: c.isNotNull()), F.lit(0))
