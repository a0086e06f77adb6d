"""Helpers shared by the operators: settings, Arrow access, cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import cut

__all__ = ["append_column", "batch_settings", "cut", "partitions", "read", "slots", "utf8", "with_hint"]


def batch_settings(spark: SparkSession) -> None:
    """Small Arrow batches: documents may be long, and a Python worker holds a few batches at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    batch_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying the text; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], body[at[0]:at[-1]]


def append_column(df: DataFrame, name: str, kind: T.DataType, source: str, fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with the column `name` computed batch by batch from column `source`; a column of that name is replaced."""
    rest = df.drop(name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, kind, True)])
    has = source in rest.columns
    if not has:
        raise ValueError(f"no column {source}")
    place = rest.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns, fn(batch.column(place))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rest.mapInArrow(run, schema)


def slots(*columns: str) -> F.Column:
    """A hash of the columns, the same for equal rows in every run."""
    return F.xxhash64(*[F.col(c) for c in columns])


def with_hint(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str = "_hint") -> DataFrame:
    """rows with a boolean `name`: false only where no row of the stored table wanted has these keys, so that such rows need not be
    shuffled to be joined. The hint is a bit for each hash, eight to a wanted row; one other row in nine at most passes until the bitmap
    reaches 8 MB, more beyond that."""
    bits = min(1 << 26, max(1 << 15, 1 << (8 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(bits))
    place = F.lit(1 << 15).cast("long")
    maps = wanted.select(F.floor(slot / place).alias("_page"), (slot % place).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    paged = rows.withColumn("_slot", slot).withColumn("_at", F.floor(F.col("_slot") / place))
    found = paged.join(F.broadcast(maps), F.col("_at") == F.col("_page"), "left")
    byte = "cast(conv(hex(substring(_bits, cast(_slot % 32768 div 8 AS int) + 1, 1)), 16, 10) AS int)"
    hit = F.coalesce(F.expr(f"shiftright({byte}, cast(_slot % 8 AS int)) & 1 = 1"), F.lit(False))
    return found.withColumn(name, hit).drop("_slot", "_at", "_page", "_bits")
