"""Files of any size and length, parsed across tasks: one row per physical line instead of one row per file.

Spark reads such a file in ranges of lines. Where a line starts inside a quoted field depends on every line before it, so
each line is taken as a function from the state it is entered in (outside or inside quotes) to the one it leaves.
Only four such functions exist: always outside, always inside, keep, and turn round. They compose, so a window over each range
gives the state of its lines as a function of the range's own, a table of ranges (a row each) gives every range its entry
state by a prefix scan, and the two are joined. Lines entered and left outside are records already; those of longer records, which may
cross any number of ranges, are brought together by the line they start on. Nothing holds a whole file.

Lines end at LF, CR LF or CR, as in files parsed in one piece. A file whose only line ends are CR is read as one row; pass
`line_end="\\r"` for it. A record longer than MAX_RECORD characters (an unclosed quote) is never put together: its file is
`malformed_csv`, as an oversized field makes it. Null or empty lists of paths give empty tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.cells import strip
from tallyframe.schema import KEYS, MAX_COLUMNS, MAX_FIELD_CHARS
from tallyframe.session import cut
from tallyframe.sources import delimited
from tallyframe.sources.landing import DELIMITERS, UTF8_BOM, file_name, tenant

MAX_RECORD = MAX_COLUMNS * (MAX_FIELD_CHARS + 3)
FILE = ["path"]
RANGE = ["path", "block"]


def physical_lines(spark: SparkSession, paths: list[str], line_end: str = "\n") -> DataFrame:
    """(path, tenant_id, export_id, size, block, at, text, had_end): every line with the range it starts in and its order there."""
    if not paths:
        return spark.createDataFrame([], "tenant_id string, export_id string, path string, size long, block long, at struct<id:long,part:int>, text string, ended string")
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]  # names are no patterns
    raw = spark.read.text(plain, lineSep=line_end).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("modificationTime"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    # Single CRs end lines too. The CR of a CR LF stays with the line end.
    ends = F.when(F.col("value").endswith("\r") & F.lit(line_end == "\n"), F.lit("\r\n")).otherwise(F.lit(line_end))
    body = F.when(ends == "\r\n", F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    parts = F.when(body.contains("\r"), F.split(body, "\r", -1)).otherwise(F.array(body))
    many = raw.select(tenant().alias("tenant_id"), file_name().alias("export_id"), "path", F.col("length").alias("size"), "block", "id", ends.alias("last"), F.posexplode(parts).alias("part", "text"),
                      (F.size(parts) - 1).alias("parts"))
    return many.select(*KEYS, "path", "size", "block", F.struct("id", "part").alias("at"), "text",
                       F.when(F.col("part") < F.col("parts"), "\r").otherwise(F.col("last")).alias("ended"))


def _leaves_inside(text: Column, delimiter: str) -> tuple[Column, Column]:
    """(entered outside, entered inside): whether the line is left inside a quoted field."""
    d, field = delimited._quoted(delimiter), delimited.field_pattern(delimiter)
    unclosed = rf'(?:{field}{d})*+"(?:[^"]++|"")*+\z'
    outside = text.contains('"') & text.rlike(rf"\A{unclosed}")
    inside = ~text.contains('"') | text.rlike(rf'\A(?:[^"]++|"")*+(?:\z|"[^{d}\r\n]*+{d}{unclosed})')
    return outside, inside


def with_states(lines: DataFrame, delimiter: Column) -> DataFrame:
    """lines with `line` (number in the file), `inside` (entered inside quotes), `start` (the line their record starts on).

    `delimiter`: of the line's file. The lines are shuffled once, to bring a range together; ranges are bounded by the
    reader's split size, so no task holds more than that."""
    outs, ins = F.lit(None).cast("boolean"), F.lit(None).cast("boolean")
    for mark in DELIMITERS:
        out, inn = _leaves_inside(F.col("text"), mark)
        outs, ins = F.when(delimiter == mark, out).otherwise(outs), F.when(delimiter == mark, inn).otherwise(ins)
    moved = lines.withColumns({"_out": F.coalesce(outs, F.lit(False)), "_in": F.coalesce(ins, F.lit(False))})
    order = Window.partitionBy(*RANGE).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("_out") & ~F.col("_in")).cast("int")
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("state"), F.col("_turned").alias("turned")))
    # A line's state: that of the last line with only one way out, turned round once for each turning line since.
    scanned = cut(
        moved.withColumn("_n", F.row_number().over(order).cast("bigint")).withColumn("_turned", F.coalesce(F.sum(turns).over(order), F.lit(0)))
        .withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before))
        .withColumn("_before", F.col("_turned") - turns).withColumn("_own", fixed)
        .drop("_in", "_out"))
    odd = lambda n: n % 2 == 1
    # One row per range: its own function and number of lines.
    of_range = scanned.groupBy(*RANGE).agg(
        F.max("_n").alias("lines"), F.max("_turned").alias("turned"), F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_n"))).alias("own"))
    in_file = Window.partitionBy(*FILE).orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # Over ranges the same scan: a range with a fixed line fixes the state, others turn it or leave it.
    ends_in = F.when(F.col("own").isNotNull(), F.col("own.state") != odd(F.col("turned") - F.col("own.turned")))
    flips = F.when(F.col("own").isNull(), (F.col("turned") % 2)).otherwise(0)
    ranges = of_range.withColumns({"ends_in": ends_in, "flips": flips}).withColumn("flipped", F.sum("flips").over(in_file)).withColumns({
        "last_fixed": F.last(F.when(F.col("ends_in").isNotNull(), F.struct("ends_in", "flipped")), ignorenulls=True).over(earlier),
        "flipped_before": F.col("flipped") - F.col("flips"),
        "lines_before": F.coalesce(F.sum("lines").over(earlier), F.lit(0))})
    entered = F.when(F.col("last_fixed").isNull(), odd(F.col("flipped_before"))).otherwise(
        F.col("last_fixed.ends_in") != odd(F.col("flipped_before") - F.col("last_fixed.flipped")))
    entry = cut(ranges.select(*RANGE, "lines_before", entered.alias("entered")))
    inside = F.when(F.col("_fixed").isNotNull(), F.col("_fixed.state") != odd(F.col("_before") - F.col("_fixed.turned"))).otherwise(
        F.col("entered") != odd(F.col("_before")))
    placed = scanned.join(entry, RANGE).select(
        *KEYS, "path", "size", "block", "at", "text", "ended", (F.col("_n") + F.col("lines_before")).alias("line"), inside.alias("inside"))
    # The last record start at or before a line; where its range has none yet, the last of earlier ranges.
    begins = F.when(~F.col("inside"), F.col("line"))
    stored = cut(placed.withColumn("_start", F.max(begins).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    last = stored.groupBy(*RANGE).agg(F.max("_start").alias("last")).withColumn("carried", F.max("last").over(earlier))
    return stored.join(cut(last.select(*RANGE, "carried")), RANGE).withColumn("start", F.coalesce("_start", "carried")).drop("_start", "carried")


def records(lines: DataFrame) -> DataFrame:
    """(tenant_id, export_id, path, line, body) from lines with states; `body` is null where a record is too long to be put together."""
    spans = lines.where("inside").groupBy(*KEYS, "path", "start").agg(F.sum(F.length("text") + 2).alias("chars"), F.max("line").alias("last"))
    single = lines.join(spans.select(*KEYS, "path", F.col("start").alias("line")), [*KEYS, "path", "line"], "left_anti").where("NOT inside").select(*KEYS, "path", "line", F.col("text").alias("body"))
    whole = spans.where(F.col("chars") <= MAX_RECORD).select(*KEYS, "path", "start")
    pieces = F.array_sort(F.collect_list(F.struct("line", "text", "ended")))  # of one record, bounded by MAX_RECORD characters
    several = lines.join(whole, [*KEYS, "path", "start"]).groupBy(*KEYS, "path", "start").agg(pieces.alias("_pieces"), F.max("line").alias("_last"))
    several = several.select(*KEYS, "path", F.col("_last").alias("line"), F.aggregate(
        "_pieces", F.lit(""), lambda s, x: F.concat(s, x["text"], F.when(x["line"] < F.col("_last"), x["ended"]).otherwise(""))).alias("body"))
    long = spans.where(F.col("chars") > MAX_RECORD).select(*KEYS, "path", F.col("last").alias("line"), F.lit(None).cast("string").alias("body"))
    return single.unionByName(several).unionByName(long)


def sampled_delimiter(lines: DataFrame, sample: int = delimited.SAMPLE_LINES) -> DataFrame:
    """(path, lines, delimiter) judged on each file's first lines, as files in one piece are; `lines` is 0 for no delimiter."""
    earlier = Window.partitionBy(*FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    early = lines.groupBy(*RANGE).count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).where(F.col("_before") < sample)
    first = Window.partitionBy(*FILE).orderBy("block", "at")
    head = lines.join(cut(early.select(*RANGE)), RANGE).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= sample)
    text = head.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("_k", "text"))).alias("_head")).select(
        *FILE, F.array_join(F.filter(F.transform("_head", lambda x: x["text"]), lambda t: strip(t) != ""), "\n").alias("_sample"))
    widths = text.withColumns({f"_w{i}": delimited.sample_widths(F.col("_sample"), mark) for i, mark in enumerate(DELIMITERS)})
    best = delimited.profile_delimiter([F.col(f"_w{i}") for i in range(len(DELIMITERS))])
    return widths.withColumn("_p", best).select(*FILE, F.col("_p.lines").alias("lines"), F.col("_p.delimiter").alias("delimiter"))


def width_histogram(lines: DataFrame) -> DataFrame:
    """(path, rank, width, n, seen): records of each width under every delimiter, over all lines; `seen`: line of the first.

    Each delimiter has its own quote states, so the lines are scanned once for each; counts of ranges merge by sum and minimum."""
    found = None
    for rank, mark in enumerate(DELIMITERS):
        of = records(with_states(lines, F.lit(mark))).where("body IS NOT NULL")
        filled = of.where(~delimited.is_blank(F.col("body"), F.lit(mark)))
        counted = filled.select(*FILE, "line", F.size(delimited.split_fields(F.col("body"), F.lit(mark))).alias("width")).groupBy(*FILE, "width").agg(
            F.count("*").alias("n"), F.min("line").alias("seen")).select(*FILE, F.lit(rank).alias("rank"), "width", "n", "seen")
        found = counted if found is None else found.unionByName(counted)
    return found


def profiled_delimiter(lines: DataFrame) -> DataFrame:
    """(path, lines, delimiter) judged on all lines, by the sample's rule: the most frequent width of each delimiter (first seen wins a
    tie), its frequency if above one, then the width, then the earlier delimiter."""
    mode = width_histogram(lines).groupBy(*FILE, "rank").agg(F.max(F.struct("n", (-F.col("seen")).alias("seen"), "width")).alias("m"))
    scored = mode.groupBy(*FILE).agg(F.max(F.struct(F.when(F.col("m.width") > 1, F.col("m.n")).otherwise(0).alias("lines"), F.col("m.width"), (-F.col("rank")).alias("order"))).alias("b"))
    return scored.select(*FILE, F.col("b.lines"), F.element_at(F.array(*map(F.lit, DELIMITERS)), 1 - F.col("b.order")).alias("delimiter"))


def file_checks(lines: DataFrame) -> DataFrame:
    """(tenant_id, export_id, path, had_bom, code): what is wrong with a file's bytes."""
    counted = lines.groupBy(*KEYS, "path").agg(
        F.sum(F.octet_length("text") + F.octet_length("ended")).alias("bytes"), F.first("size").alias("size"),
        F.bool_or(F.contains("text", F.lit("\x00"))).alias("nul"), F.bool_and(F.is_valid_utf8("text")).alias("fine"),
        F.bool_and(F.length(F.regexp_replace("text", r"[ \t\n\r\x0b\f]", "")) == 0).alias("blank"),
        F.min_by("text", F.struct("block", "at")).alias("first"))
    # The reader drops a byte-order mark and may add a last line end: what is missing is the mark.
    marked = (F.col("bytes") < F.col("size")) | (F.hex(F.substring(F.col("first").cast("binary"), 1, 3)) == UTF8_BOM)
    code = F.when(F.col("blank"), "empty_file").when(F.col("nul"), "binary_content").when(~F.col("fine"), "not_utf8")
    return counted.select(*KEYS, "path", marked.alias("had_bom"), code.alias("code"))
