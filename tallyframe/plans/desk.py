"""The star-schema tables read as the persisted desk tables: customers as leads, orders as files and
runs, line items as findings and stored answers. Every row of each table is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.plans.star import table

PROVIDER = "classifier"


def _tenant(key: str) -> Column:
    return F.concat(F.lit("T"), F.col(key).cast("string"))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lit("owner"), F.floor(F.col("c_custkey") / 4).cast("string"), F.lit("@example.com"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("lead_id"), _tenant("c_custkey").alias("tenant_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.upper(mail)).otherwise(mail).alias("email"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "pilot_requested").otherwise("new").alias("status"),
        F.dateadd(F.lit("1995-01-01").cast("date"), F.floor(F.col("c_acctbal")).cast("int") % 1000).cast("timestamp_ntz").alias("created_at"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "accepted").otherwise("rejected")
    content = F.concat_ws("-", F.col("o_custkey").cast("string"), F.floor(F.col("o_totalprice") / 50000).cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"), _tenant("o_custkey").alias("tenant_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("lead_id"),
        F.sha2(content, 256).alias("sha256"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("raw_deleted_at"),
        F.concat(F.lit("export-"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "insufficient_data")
              .otherwise("completed"))
    w = lambda code, severity, message: F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    seen = F.floor("o_totalprice").cast("bigint")
    base = table(spark, sf_dir, "orders").withColumn("_s", status)
    return base.select(
        F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("run_id"), _tenant("o_custkey").alias("tenant_id"),
        F.col("o_orderkey").alias("file_id"), F.col("_s").alias("status"),
        F.when((F.col("_s") == "completed") & (F.col("o_orderpriority") != "3-MEDIUM"),
               F.trunc(F.col("o_orderdate").cast("date"), "month")).alias("month"),
        F.col("o_orderdate").alias("created_at"), F.when(F.col("_s") != "failed", F.col("o_orderdate")).alias("completed_at"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("unlocked_at"),
        seen.alias("rows_seen"), (seen - seen % 7).alias("rows_accepted"), (seen % 7).alias("rows_rejected"),
        F.when(F.col("_s") == "failed", F.array(w("no_valid_rows", "error", "No rows could be read.")))
        .when(F.col("_s") == "insufficient_data", F.array(
            w("partial_period", "warning", "Some months are incomplete."), w("no_comparison", "error", "Nothing to compare.")))
        .otherwise(F.array().cast("array<struct<code:string,severity:string,message:string>>")).alias("warnings"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per (order, brand)."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey", "p_brand").agg(
            F.sum(price).alias("observed_value"), F.sum(price * F.col("l_discount").cast("decimal(4,2)")).alias("delta_value"),
            F.bool_or(F.col("l_returnflag") == "R").alias("review_required"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("observed_value"), "p_brand"))
    key = F.concat(F.lit("material_increase_service_"), F.substring(F.sha2("p_brand", 256), 1, 8))
    return rows.withColumn("rank", rank).select(
        _tenant("o_custkey").alias("tenant_id"), F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("run_id"),
        key.alias("finding_key"), F.concat("p_brand", F.lit(" up")).alias("title"), "rank",
        F.when(F.col("rank") == 1, "INVESTIGATE").otherwise("MONITOR").alias("final_category"),
        "observed_value", "delta_value", "review_required")


def pilots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        _tenant("o_custkey").alias("tenant_id"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("lead_id"),
        (F.col("o_orderstatus") == "P").alias("manual_review_only"))


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        _tenant("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("file_id"), F.lit(PROVIDER).alias("provider"),
        (F.col("o_orderpriority") != "2-HIGH").alias("granted"), F.col("o_orderdate").alias("created_at"))


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored answer per line item. Lines with flag N name a category that does not exist."""
    choice = F.when(F.col("l_returnflag") == "A", "INVESTIGATE").when(F.col("l_returnflag") == "R", "MONITOR").otherwise("RESIZE")
    conf, p = F.col("l_discount") * 5, F.col("l_tax") * 10
    pick = lambda v: F.struct(
        F.lit("choice").alias("type"), v.alias("choice"), conf.alias("confidence"), F.create_map(v, conf).alias("probabilities"))
    score = lambda n: F.struct(
        F.lit("score").alias("type"), n.alias("score"), F.lit(0.8).alias("confidence"), F.create_map(F.lit("1"), F.lit(0.8)).alias("probabilities"))
    yes = F.struct(F.lit("noul").alias("type"), p.alias("noul"))
    answers = F.to_json(F.struct(
        pick(choice).alias("decision_category"), pick(F.lit("data")).alias("owner_group"),
        # Quantities 1..50 fall between and beyond the levels: 2.5 is a tie, above 3 is out of range.
        score(F.col("l_quantity") / 16).alias("urgency"), score(F.lit(1.0)).alias("risk_without_evidence"),
        pick(F.lit("change_context")).alias("primary_missing_evidence"), yes.alias("evidence_sufficient"),
        yes.alias("needs_human_review"), yes.alias("change_material")))
    # Line keys repeat within an order; the supplier makes the order of the calls total.
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        _tenant("o_custkey").alias("tenant_id"), F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("packet_sha256"), F.lit("qs/1").alias("question_set_version"),
        F.lit(PROVIDER).alias("provider"), F.lit("model-1").alias("model_requested"),
        F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed").alias("status"), answers.alias("answers"),
        line.alias("created_at"))
