"""Arriving exports: picked up once, analysed as a batch, written idempotently."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators import monthly, packets
from tallyframe.plans.ingest import ParsedExports, one_per_export
from tallyframe.schema import KEYS, MAX_FILE_BYTES, PACKET_V1, PARSER_VERSION
from tallyframe.session import configure, cut
from tallyframe.sources.landing import FILE_SCHEMA, read_paths, too_large, verify_hash
from tallyframe.sources.keyed import KeyedStore
from tallyframe.sources.ranges import physical_lines
from tallyframe.sources.sinks import read_table, write_run


def analyse_files(files: DataFrame, today: date, calls: DataFrame | None = None, permission: DataFrame | None = None,
                  version: str = PACKET_V1, refused: DataFrame | None = None, large: DataFrame | None = None) -> dict[str, DataFrame]:
    """Result tables of one set of files. Files `refused` unread (`landing.too_large`) are failed runs with an issue; lines of
    `large` ones (`ranges.physical_lines`) are analysed like the others.
    Without `calls` it is the first, answer-free phase; the same
    job with stored answers and permissions is the second, and overwrites the first one's rows."""
    parsed = ParsedExports(files, large=large)
    a = parsed.analysis(today)
    decided = a._cut(a.decide(a.with_answers(calls, permission, version)))
    packed = a._cut(a.packets(version))
    refs = F.transform(F.coalesce("refs", F.array().cast("array<struct<line:bigint,col:int>>")), monthly.ref_text)
    status = F.when(F.col("has_pair"), "completed").otherwise("insufficient_data")
    done = (
        a.focus.select(*KEYS, status.alias("status"), "current_month").join(a.summary, KEYS)
        .join(packets.run_hash(packed), KEYS, "left"))
    fatal = parsed.fatal
    if refused is not None:
        fatal = fatal.unionByName(refused.select(
            *KEYS, "code", F.lit("error").alias("severity"), "message", F.lit(None).cast("bigint").alias("count"),
            F.to_json(F.struct("path", "length")).alias("detail")))
    failed = fatal.select(*KEYS, F.lit("failed").alias("status"))
    run = done.unionByName(failed, allowMissingColumns=True).withColumn("parser_version", F.lit(PARSER_VERSION)).withColumn(
        "packet_version", F.lit(version))
    return {
        "record": parsed.records, "rejection": parsed.rejections, "rejection_sample": parsed.rejection_sample,
        "issue": a.issues.unionByName(fatal), "coverage": a.coverage, "profile": parsed.profile,
        "finding": decided.withColumn("refs", refs), "packet": packed, "run": run,
    }


def ingest_batch(files: DataFrame, out: str, today: date, batch: str | None = None, split_large: bool = False, source_file: DataFrame | None = None) -> None:
    """Analyse the files not seen before and write their tables. files: path, length, modificationTime.

    Contents are hashed where they are read and dropped there. Which files are new is decided on the hashes, and
    only those are read again, so no join moves contents. The batch's size bounds the paths named to the readers.
    An export counts as seen if this parser's version has done it. With a `batch` name tables are kept in buckets
    (`sources.keyed`): a batch reads only the ledger's buckets that its exports can lie in, and the number of files does not
    grow with exports. `split_large` parses files over the limit in ranges of lines instead of refusing them. With a
    `source_file` table of uploads (`landing.verify_hash`) files whose bytes are not those recorded, or whose upload was deleted,
    become failed runs; files without a record are left alone."""
    spark = files.sparkSession
    arrived = cut(files.select("path", "length", "modificationTime"))
    small = [r.path for r in arrived.where(F.col("length") <= MAX_FILE_BYTES).select("path").collect()]
    hashed = cut(read_paths(spark, small).select(*KEYS, "path", "length"))
    refused = too_large(arrived)
    if source_file is not None:
        hashed, wrong = verify_hash(hashed, source_file)
        # The same bytes may lie well under one path and be wrong under another: then the export is analysed.
        lost = wrong.join(hashed.select(*KEYS), KEYS, "left_anti").groupBy(*KEYS).agg(F.min(F.struct("path", "code", "message")).alias("w"))
        refused = refused.unionByName(lost.select(*KEYS, "w.path", F.lit(None).cast("bigint").alias("length"), "w.code", "w.message"))
    fresh = one_per_export(hashed)
    current = f"parser_version = '{PARSER_VERSION}'"
    store = None if batch is None else KeyedStore(spark, out)
    if store is not None:
        fresh, refused = (store.unknown(df, batch, current) for df in (fresh, refused))
    else:
        known = read_table(spark, out, "run")
        if known is not None:
            done = known.where(current).select(*KEYS)
            fresh, refused = (df.join(done, KEYS, "left_anti") for df in (fresh, refused))
    refused = cut(refused)  # the tables below are written over what `known` reads
    new = read_paths(spark, [r.path for r in fresh.select("path").collect()])
    large = None
    if split_large:
        large = physical_lines(spark, [r.path for r in refused.where("code = 'file_too_large'").select("path").collect()])
        refused = refused.where("code <> 'file_too_large'")
    tables = analyse_files(new, today, refused=refused, large=large)
    if store is not None:
        store.write(tables, batch)
    else:
        write_run(tables, out)


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, today: date,
                  max_files: int = 10_000, keyed: bool = False, split_large: bool = False, source_file: DataFrame | None = None) -> StreamingQuery:
    """Process what has arrived since the last call and stop. `keyed`, `split_large` and `source_file` as in `ingest_batch`.

    State lives in the file source's checkpoint and in the written tables; there is no per-key state
    to grow. A batch that is retried after a failure overwrites the partitions it wrote before.
    """
    configure(spark)
    arriving = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
                .option("maxFilesPerTrigger", max_files).load(landing).select("path", "length", "modificationTime"))
    return (arriving.writeStream.foreachBatch(lambda files, n: ingest_batch(files, out, today, f"ingest-{n}" if keyed else None, split_large, source_file))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
