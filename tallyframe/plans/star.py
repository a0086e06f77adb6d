"""The star-schema tables read as billing exports: one export per region, months as periods.

Every mapping keeps every row of the tables it reads.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.cells import is_unallocated_label
from tallyframe.schema import KEYS
from tallyframe.session import spread

#: Report date of the star exports: October 2001 is their last complete month.
TODAY = date(2001, 11, 15)
LAUNCH = date(2001, 10, 1)
LAUNCH_BRAND = "Brand#11"
UNTAGGED_SEGMENT = "HOUSEHOLD"
DIMENSIONS_AVAILABLE = ["service", "account", "region", "usage_type", "tag", "environment", "charge_type"]


#: Tables whose rows cost much work each; they are spread when they come as too few files.
HEAVY = {"lineitem", "documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df) if name in HEAVY else df


def line_cost() -> Column:
    """Exact in both engines: two-place price times one minus a two-place discount."""
    one = F.lit(1).cast("decimal(4,2)")
    return (F.col("l_extendedprice").cast("decimal(18,2)") * (one - F.col("l_discount").cast("decimal(4,2)")))


def environment() -> Column:
    return (F.when(F.col("o_orderstatus") == "F", "production").when(F.col("o_orderstatus") == "O", "staging")
            .otherwise("dev-sandbox"))


def records(spark: SparkSession, sf_dir: str, variant: str = "tagged", grain: str = "month") -> DataFrame:
    """cost_record from lineitem and its dimensions; see `varied` for the variants.

    Orders meet their customers before the line items come, so these are shuffled once for each of their own three
    keys at most, as few narrow numbers; costs are worked out at the end."""
    t = lambda name: table(spark, sf_dir, name)
    customer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_mktsegment", "r_name")
    supplier = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_name", "n_name")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(
        customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_mktsegment", "r_name")
    part = t("part").select("p_partkey", "p_brand", "p_type")
    day = F.col("l_shipdate").cast("date")
    month = F.trunc("day", "month")
    lines = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", day.alias("day"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)").alias("l_discount"))
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    tag = F.col("c_mktsegment")
    return varied(rows.select(
        F.col("r_name").alias("tenant_id"), F.col("r_name").alias("export_id"),
        (F.col("day") if grain == "day" else month).alias("period_start"), month.alias("month"),
        F.col("p_brand").alias("service"), F.col("p_type").alias("usage_type"), F.col("s_name").alias("account"),
        F.col("n_name").alias("region"), tag.alias("tag"), environment().alias("environment"),
        F.col("l_returnflag").alias("charge_type"),
        line_cost().cast("decimal(28,15)").alias("cost"), F.lit("USD").alias("currency"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.lit(None).cast("int").alias("col"),
        is_unallocated_label(tag).alias("unallocated"),
        F.col("l_quantity").cast("decimal(38,15)").alias("quantity"), F.col("l_returnflag").alias("unit"),
    ), variant)


def varied(rows: DataFrame, variant: str) -> DataFrame:
    """variant "tagged": every row has an owner tag. "untagged": one segment has none. "launch": rows of
    one brand in the last complete month carry a label never seen before."""
    service, tag = F.col("service"), F.col("tag")
    if variant == "launch":
        return rows.withColumn("service", F.when((F.col("month") == F.lit(LAUNCH)) & (service == LAUNCH_BRAND), F.concat(service, F.lit(" Next"))).otherwise(service))
    if variant == "untagged":
        bare = F.when(tag == UNTAGGED_SEGMENT, "No tag key: segment").otherwise(tag)
        return rows.withColumns({"tag": bare, "unallocated": is_unallocated_label(bare)})
    return rows


def profile(records_df: DataFrame) -> DataFrame:
    """What parsing would say about these exports; the parts records alone determine."""
    return _profile(records_df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("lines_accepted"), F.sum("cost").alias("total_cost")))


def profile_of(coverage: DataFrame) -> DataFrame:
    """The same from the month table, which already holds the counts and sums."""
    return _profile(coverage.groupBy(*KEYS).agg(
        F.sum("records").alias("lines_accepted"), F.sum("total").alias("total_cost")))


def _profile(totals: DataFrame) -> DataFrame:
    return totals.withColumn("currency", F.lit("USD")).select(
        *KEYS, F.lit("long").alias("layout"), F.lit("service").alias("primary_dimension"),
        F.lit("Service").alias("dimension_label"),
        F.array(*map(F.lit, DIMENSIONS_AVAILABLE)).alias("dimensions_available"), "currency",
        F.col("lines_accepted").alias("lines_seen"), "lines_accepted",
        F.lit(0).cast("bigint").alias("lines_rejected"), F.lit(0).cast("bigint").alias("cells_rejected"),
        F.lit(0).cast("bigint").alias("empty_cells"), F.lit(0).cast("bigint").alias("duplicate_lines"),
        F.col("lines_accepted").alias("records"), "total_cost",
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as one daily export: event type as service, user as account."""
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("tenant_id"), F.lit("events").alias("export_id"),
        day.alias("period_start"), F.trunc(day, "month").alias("month"),
        F.col("event_type").alias("service"), F.col("user_id").cast("string").alias("account"),
        F.get_json_object("props", "$.k").alias("tag"),
        F.col("value").cast("decimal(18,2)").cast("decimal(28,15)").alias("cost"), F.lit(None).cast("string").alias("currency"),
        F.col("event_id").alias("line"), F.lit(None).cast("int").alias("col"), F.lit(False).alias("unallocated"),
        F.lit(None).cast("decimal(38,15)").alias("quantity"), F.lit(None).cast("string").alias("unit"),
    )
