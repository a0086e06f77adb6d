"""Landing files: scan, fingerprint, integrity, duplicate uploads, content screening."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.cells import strip
from tallyframe.schema import MAX_FILE_BYTES

# ---- fixed values: first bytes of files that are never delimited text ------------------------------
SIGNATURES = [
    "504B0304", "504B0506", "25504446", "89504E47", "FFD8FF", "47494638", "1F8B", "D0CF11E0",
    "50415231", "377ABCAF", "52617221", "FFFE", "FEFF",
]
UTF8_BOM = "EFBBBF"
DELIMITERS = [",", ";", "\t", "|"]
TENANT_IN_PATH = r"tenant_id=([^/]+)/"
# ---- fixed values: load messages ---------------------------------------------------------------------
LOAD_MESSAGES = {
    "file_too_large": "The file is larger than the 25 MB limit.",
    "integrity_mismatch": "The stored file does not match what was uploaded, so it was not analyzed. Please upload it again.",
    "raw_file_deleted": "The uploaded file has already been deleted under the retention policy. Please upload it again.",
}


FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

#: Owner of files whose path names no tenant: they are analysed and reported, but nobody's.
NO_TENANT = "_unassigned"


def tenant(path: str = "path") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, TENANT_IN_PATH, 1), F.lit("")), F.lit(NO_TENANT))


def with_identity(raw: DataFrame) -> DataFrame:
    """Tenant from the path and the content hash that names the export."""
    return raw.select(
        tenant().alias("tenant_id"), F.sha2("content", 256).alias("export_id"),
        "path", "length", "modificationTime", "content")


def read_landing(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files up to the size limit, one row each. The length filter reaches the source, so the content
    of an oversized file is never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_identity(raw.where(F.col("length") <= max_bytes))


def file_name() -> Column:
    """Name of an export whose bytes are not hashed: from path, length and time."""
    return F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)


def too_large(arrived: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files above the limit as failed exports. They are not read, so path, length and time name the export."""
    return arrived.where(F.col("length") > max_bytes).select(
        tenant().alias("tenant_id"), file_name().alias("export_id"), "path", "length",
        F.lit("file_too_large").alias("code"), F.lit(LOAD_MESSAGES["file_too_large"]).alias("message"))


def oversized(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """What `read_landing` leaves out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return too_large(raw, max_bytes)


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The named files, one row each."""
    if not paths:
        return with_identity(spark.createDataFrame([], FILE_SCHEMA))
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]  # names are no patterns
    return with_identity(spark.read.format("binaryFile").load(plain))


def verify_hash(files: DataFrame, source_file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that match their recorded hash, load issues). source_file: tenant_id, path, sha256, raw_deleted_at.

    Files without a record are in neither. Only names and hashes are joined: the first result has no contents, which `read_paths` reads."""
    files = files.drop("content")
    recorded = source_file.select("tenant_id", "path", F.col("sha256").alias("_sha"), F.col("raw_deleted_at").alias("_gone"))
    checked = files.join(recorded, ["tenant_id", "path"])
    code = (F.when(F.col("_gone").isNotNull(), "raw_file_deleted")
            .when(F.col("_sha") != F.col("export_id"), "integrity_mismatch"))
    messages = F.create_map(*[F.lit(x) for kv in LOAD_MESSAGES.items() for x in kv])
    ok = checked.where(code.isNull()).drop("_sha", "_gone")
    issues = checked.where(code.isNotNull()).select(
        "tenant_id", "export_id", "path", code.alias("code"), F.lit("error").alias("severity"), messages[code].alias("message"))
    return ok, issues


def dedupe_uploads(source_file: DataFrame) -> DataFrame:
    """Earliest accepted copy of the same bytes per tenant.

    `row_number() = 1` is limited inside each map task first, so a file uploaded a million times
    shuffles one row per task.
    """
    first = Window.partitionBy("tenant_id", "sha256").orderBy("created_at", "file_id")
    return (
        source_file.where(F.col("status") != "rejected")
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    )


def duplicate_of(source_file: DataFrame) -> DataFrame:
    """Every later copy with the file that is kept instead."""
    accepted = source_file.where(F.col("status") != "rejected")
    kept = accepted.groupBy("tenant_id", "sha256").agg(
        F.min_by("file_id", F.struct("created_at", "file_id")).alias("duplicate_of"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") > 1).drop("_n")
    return accepted.join(kept, ["tenant_id", "sha256"]).where(F.col("file_id") != F.col("duplicate_of")).select(
        "tenant_id", "file_id", "sha256", "duplicate_of")


def starts_with_bom(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == UTF8_BOM


def screen(files: DataFrame) -> DataFrame:
    """Adds `reject_code`: the first content check that fails, NULL for plausible delimited text."""
    head = F.hex(F.substring("content", 1, 8))
    signature = F.lit(False)
    for s in SIGNATURES:
        signature = signature | head.startswith(s)
    text = F.col("content").cast("string")
    body = F.when(starts_with_bom(F.col("content")), F.expr("substring(cast(content as string), 2)")).otherwise(text)
    first_line = F.regexp_extract(body, r"\A([^\n]*?)(?:\r?\n|\z)", 1)
    delimited = F.lit(False)
    for d in DELIMITERS:
        delimited = delimited | first_line.contains(d)
    code = (
        F.when(F.length("content") == 0, "empty")
        .when(signature, "binary_signature")
        .when(F.contains(F.col("content"), F.lit(bytearray(b"\x00"))), "nul_bytes")
        .when(~F.is_valid_utf8(text), "not_utf8")
        .when((strip(first_line) == "") | ~delimited, "not_delimited_text")
    )
    return files.withColumn("reject_code", code)
