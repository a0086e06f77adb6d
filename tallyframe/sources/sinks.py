"""Result tables on shared storage, written idempotently per (tenant, export)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from tallyframe.schema import KEYS


def write_table(df: DataFrame, out: str, name: str) -> None:
    """Overwrite exactly the exports present in `df`; running it again gives the same files.

    Rows are brought together by export first, so an export becomes one file. An export is at most
    one accepted upload, which bounds that task.
    """
    (df.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*KEYS).parquet(f"{out.rstrip('/')}/{name}"))


def write_run(tables: dict[str, DataFrame], out: str) -> None:
    """All tables of a batch. The run table goes last: its partition marks the export as done."""
    for name in sorted(tables, key=lambda n: n == "run"):
        write_table(tables[name], out, name)


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """A result table with its keys as text, or None before the first write.

    Keys stand in the folder names. The session does not infer their types (`session.RUNTIME_CONF`), so that
    a tenant `007` stays what it was."""
    path = f"{out.rstrip('/')}/{name}"
    try:
        df = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # an unreadable table is an error, not an empty one
            raise
        return None
    return df.select(*[df[c].cast("string").alias(c) if c in KEYS else df[c] for c in df.columns])
