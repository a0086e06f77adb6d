"""Export files written from the star tables, to run the ingest over whole tables.

An export holds the line items of a fixed range of orders, so its size is bounded however large the
tables are. Damage is planted by properties of the row, so its amount is known from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.star import table

ORDERS_PER_FILE = 2048
HEADER = "Date,Service,Linked Account Name,Unblended Cost,Currency,Usage Quantity,Usage Unit,Team"


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUR-like files: thousands separators and quotes everywhere; flag N on tax-free lines has no
    cost, flag R on tax-free lines an unreadable one, and every line of ten pieces appears twice."""
    rows = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        # What a line is written from is shuffled, once, and not the lines.
        .select(F.floor(F.col("l_orderkey") / ORDERS_PER_FILE).alias("chunk"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), "l_partkey", "l_suppkey", "p_brand", "p_name",
                "o_orderpriority", "l_shipdate", "l_extendedprice", (F.col("l_tax") == 0).alias("untaxed"), "l_returnflag", "l_quantity")
        .repartition("chunk")
    )
    cost = F.when(F.col("untaxed") & (F.col("l_returnflag") == "N"), "").when(
        F.col("untaxed") & (F.col("l_returnflag") == "R"), "N/A").otherwise(
        F.concat(F.lit('"$'), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.lit('"')))
    team = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit('"Team ""'), "o_orderpriority", F.lit('"""')))
    line = F.concat_ws(
        ",", F.date_format("l_shipdate", "yyyy-MM-dd"), F.concat(F.lit('"'), F.col("p_brand"), F.lit(", "), F.col("p_name"), F.lit('"')),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")), cost, F.lit("usd"),
        F.col("l_quantity").cast("int").cast("string"), F.lit("Hrs"), team)
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("l_quantity") == 10, 2).otherwise(1)))
    numbered = rows.select("chunk", "n", "l_partkey", "l_suppkey", line.alias("text"), copies.alias("copy"))
    body = numbered.groupBy("chunk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "l_partkey", "l_suppkey", "copy", "text"))), lambda r: r["text"]), "\n").alias("body"))
    return body.select(
        F.lit("star").alias("tenant_id"), F.concat(F.lit("long-"), F.col("chunk").cast("string")).alias("export_id"),
        F.concat(F.lit("long-"), F.col("chunk").cast("string")).alias("path"),
        F.encode(F.concat(F.lit(HEADER + "\n"), "body"), "utf-8").alias("content"))


def wide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-Explorer-like files, one per region: order statuses as columns, months as rows, ';' and
    decimal commas, a total column (overstated by one in June) and a correct total row."""
    money = lambda c: F.translate(c.cast("decimal(28,2)").cast("string"), ".", ",")
    orders = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m"), "o_orderstatus",
                F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    )
    pick = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("p")))
    months = orders.groupBy("r_name", "m").agg(pick("F").alias("f"), pick("O").alias("o"), pick("P").alias("pp"))
    zero = F.lit(0).cast("decimal(28,2)")
    total = F.coalesce("f", zero) + F.coalesce("o", zero) + F.coalesce("pp", zero)
    stated = total + F.when(F.month("m") == 6, 1).otherwise(0)
    row = F.concat_ws(";", F.date_format("m", "yyyy-MM-dd"), F.coalesce(money(F.col("f")), F.lit("")),
                      F.coalesce(money(F.col("o")), F.lit("")), F.coalesce(money(F.col("pp")), F.lit("")), money(stated))
    table_rows = months.groupBy("r_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", row.alias("t")))), lambda r: r["t"]), "\r\n").alias("body"),
        F.sum("f").alias("f"), F.sum("o").alias("o"), F.sum("pp").alias("pp"))
    totals = F.concat_ws(";", F.lit("Tag: status total"), *[F.coalesce(money(F.col(c)), F.lit("0,00")) for c in ("f", "o", "pp")], F.lit(""))
    header = "Tag: status;Finished(€);Open(€);No tag key: status(€);Total costs(€)\r\n"
    return table_rows.select(
        F.lit("star").alias("tenant_id"), F.concat(F.lit("wide-"), "r_name").alias("export_id"), F.concat(F.lit("wide-"), "r_name").alias("path"),
        F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.concat(F.lit(header), totals, F.lit("\r\n"), "body"), "utf-8")).alias("content"))
