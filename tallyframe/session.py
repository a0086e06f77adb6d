"""Session settings the jobs rely on, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Skewed (tenant, export, label) joins are split even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Tenants and exports are text, also where all of them look like numbers or dates.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # The JVM does not compile methods above this many bytes; wide projections (parsing a line into
    # thirty typed columns) then run much faster split into small generated methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A row handed to Python may be a whole file or a long document; a worker holds a few batches at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings. Sizing (executors, shuffle partitions) stays with the cluster."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. One of this machine's own only serves a session that runs on this
    machine alone, as in tests; on a cluster executors would each write to their own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a reused intermediate to the shared folder and read it back.

    Lineage ends there, so a lost executor costs one re-read. A columnar table is preferred over an
    RDD checkpoint: it is computed once, later steps read only the columns they need, and its size
    on disk is known to the planner, which then broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by their keys, however few splits or row groups they are read from. For narrow rows
    that each cost much later: a number that is asked for is not coalesced by size. A task of parsing costs
    some tenths of a second before its first row, so there are a few a core and no more."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan that has fewer splits than cores (a few small files). A scan with
    enough splits, which is every large one, is left alone and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
