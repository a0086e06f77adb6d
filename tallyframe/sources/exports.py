"""Landing files to one `line` table: a single narrow pass from bytes to typed, not yet judged rows.

Every file yields one row of kind "file" with what is true of the whole file, and, unless the file is
unusable, one row per record: "data", or "total" for the stated total row of a wide export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyframe.functions import cells
from tallyframe.functions.cells import BLANK_LABEL, clean_label, is_true, is_unallocated_label, money, strip
from tallyframe.schema import DIMENSIONS, KEYS, LONG_DIMENSIONS, MAX_COLUMNS, MAX_FIELD_CHARS, OWNERSHIP_DIMENSIONS
from tallyframe.session import cut
from tallyframe.sources import delimited, layouts, plain, ranges
from tallyframe.sources.landing import DELIMITERS, UTF8_BOM

# ---- fixed values: why a file cannot be analysed -------------------------------------------------------
FATAL_MESSAGES = {
    "empty_file": "The file is empty.",
    "binary_content": "The file contains binary data. Upload the CSV export from AWS Cost Explorer.",
    "not_utf8": "The file is not UTF-8 text. Re-export it as a UTF-8 CSV.",
    "not_delimited": "The file does not look like a CSV: no comma, semicolon, tab or pipe separated columns were found.",
    "too_many_rows": "The file has more than 1,000,000 lines. Export a shorter date range or a monthly view.",
    "too_many_columns": "The file has more than 1,000 columns. Group by fewer values in Cost Explorer.",
    "malformed_csv": "The CSV could not be read (for example, an unclosed quote or an oversized field).",
    "no_data_rows": "The file has a header but no data rows.",
    "unsupported_layout": ("This does not look like an AWS billing export. Expected a Cost Explorer CSV (dates in the "
                           "first column, one column per service) or columns for date, service and cost."),
    "no_valid_rows": "No rows could be read: every row had an invalid date or cost.",
}
MISSING_COLUMNS = ("Required columns are missing: ", ". The file needs a date, a service (or account/region) and a cost column.")
NO_DIMENSION = "service (or account/region)"
NO_COST_COLUMNS = "No cost columns were found. Export from Cost Explorer with a group-by (for example, Service)."


def _decoded(files: DataFrame) -> DataFrame:
    """Text without its byte-order mark, or the reason there is none."""
    content = F.col("content")
    had_bom = F.hex(F.substring(content, 1, 3)) == UTF8_BOM
    data = F.when(had_bom, F.substring(content, 4, 2147483647)).otherwise(content)
    text = data.cast("string")
    blank = ~content.cast("string").rlike(r"[^ \t\n\r\x0b\f]")
    code = (F.when(blank, "empty_file")
            .when(F.contains(data, F.lit(bytearray(b"\x00"))), "binary_content")
            .when(~F.is_valid_utf8(text), "not_utf8"))
    return files.select(*KEYS, "path", *[c for c in files.columns if c == "_whole"], had_bom.alias("had_bom"), code.alias("_code"),
                        F.when(code.isNull(), text).alias("_text"))


def _shape(files: DataFrame) -> DataFrame:
    """Delimiter, records, header, layout and date order of every readable file."""
    sampled = _decoded(files).withColumn("_sample", delimited.sample_text(F.col("_text"))).withColumns(
        {f"_w{i}": delimited.sample_widths(F.col("_sample"), mark) for i, mark in enumerate(DELIMITERS)})
    profiled = sampled.withColumn("_p", delimited.profile_delimiter([F.col(f"_w{i}") for i in range(len(DELIMITERS))]))
    d = F.col("delimiter")
    code = F.coalesce("_code", F.when(F.coalesce("_p.lines", F.lit(0)) == 0, "not_delimited"))
    split = (
        profiled.withColumn("_code", code).withColumn("delimiter", F.when(F.col("_code").isNull(), F.col("_p.delimiter")))
        .withColumn("_blocks", F.when(F.col("_code").isNull(), delimited.blocks_of(F.col("_text"), d)))
        .withColumn("_code", F.coalesce("_code", delimited.oversize_code(F.col("_blocks"), d)))
        .withColumn("_early", F.when(F.col("_code").isNull(), delimited.records_of(F.get("_blocks", F.lit(0)), d)))
    )
    # Header and row count need the first two records that are not blank, nearly always in the first block.
    nonblank = lambda records: F.filter(records, lambda r: ~delimited.is_blank(r, d))
    everything = F.flatten(F.transform("_blocks", lambda b: delimited.records_of(b, d)))
    lead = F.slice(nonblank(F.col("_early")), 1, 2)
    led = split.withColumn("_lead", lead).withColumn(
        "_early", F.when(F.size("_lead") < 2, everything).otherwise(F.col("_early"))).withColumn(
        "_lead", F.when(F.size("_lead") < 2, F.slice(nonblank(F.col("_early")), 1, 2)).otherwise(F.col("_lead")))
    headed = (
        led.withColumn("_code", F.coalesce("_code", F.when(F.size("_lead") == 0, "empty_file").when(F.size("_lead") < 2, "no_data_rows")))
        .withColumn("_header", F.when(F.col("_code").isNull(), delimited.split_fields(
            delimited.without_newline(F.get("_lead", F.lit(0))), d)))
        .withColumn("_header_at", F.array_position("_early", F.get("_lead", F.lit(0))).cast("int"))
        .withColumn("_header_line", F.col("_header_at") + delimited.extra_lines(F.slice("_early", F.lit(1), F.col("_header_at"))))
    )
    headed = _headed(headed)
    # Date cells are only cut out of the whole file where slash dates exist or the layout depends on them.
    slashes = F.col("_text").contains("/") & F.col("_text").rlike(r"/(?<=\d/)\d{1,2}/\d{4}")
    date_index = F.when(F.col("_long"), F.col("_cols.date")).otherwise(0)
    body = F.transform(nonblank(everything), delimited.without_newline)
    date_cells = F.filter(F.transform(F.slice(body, F.lit(2), F.greatest(F.size(body), F.lit(1))),
                                      lambda r: F.get(delimited.split_fields(r, d), date_index)), lambda c: c.isNotNull())
    dated = headed.withColumn("_dates", F.when(F.col("_code").isNull() & (slashes | ~F.col("_long")), date_cells))
    over = lambda part: F.coalesce(F.exists("_dates", lambda c: F.coalesce(part(c) > 12, F.lit(False))), F.lit(False))
    any_slash = F.coalesce(F.exists("_dates", lambda c: strip(c).rlike(cells.SLASH_DATE)), F.lit(False))
    order, assumed = cells.slash_order_from(over(cells.slash_first), over(cells.slash_second), any_slash)
    ordered = dated.withColumn("slash_order", order).withColumn("date_assumed", assumed)
    return _laid_out(ordered.withColumn("_wide", layouts.looks_wide(F.col("_header"), F.col("_dates"), F.col("slash_order"))))


def _headed(led: DataFrame) -> DataFrame:
    """Adds what the header row `_header` says."""
    return (
        led.withColumn("_spaced", F.transform("_header", cells.normalized_header))
        .withColumn("_joined", F.transform("_spaced", lambda h: F.translate(h, " ", "_")))
        .withColumn("_cols", F.when(F.col("_code").isNull(), layouts.map_headers(F.col("_spaced"), F.col("_joined"))))
        .withColumn("_long", layouts.looks_long(F.col("_cols")))
    )


def _laid_out(ordered: DataFrame) -> DataFrame:
    """Layout, columns and dimensions of files whose header, date order and `_wide` are known."""
    wide = F.col("_wide")
    laid = ordered.withColumn("layout", F.when(F.col("_code").isNull(), F.when(F.col("_long"), "long").when(wide, "cost_explorer_wide")))
    dims = layouts.present(F.col("_cols"), LONG_DIMENSIONS)
    columns = F.when(F.col("layout") == "cost_explorer_wide", layouts.wide_columns(F.col("_header")))
    typed = laid.withColumn("_columns", columns).withColumn("_dims", dims)
    is_long = F.col("layout") == "long"
    missing = F.when(is_long, F.col("_cols.date").isNull() | F.col("_cols.cost").isNull() | (F.size("_dims") == 0)).otherwise(
        F.size(F.filter("_columns", lambda c: ~c["total"])) == 0)
    label = layouts.wide_label(F.col("_header"))
    primary = F.when(is_long, F.get("_dims", F.lit(0))).when(F.col("layout").isNotNull(), layouts.wide_dimension(label))
    return (
        typed.withColumn("_code", F.coalesce("_code", F.when(F.col("layout").isNull(), "unsupported_layout")
                                             .when(missing, "missing_required_columns")))
        .withColumn("primary_dimension", primary)
        .withColumn("dimension_label", F.when(is_long, F.initcap(F.translate("primary_dimension", "_", " ")))
                    .when(F.col("layout").isNotNull(), label))
        .withColumn("dimensions_available", F.when(is_long, F.col("_dims")).when(
            F.col("layout").isNotNull(), F.array("primary_dimension")))
    )


#: Facts of a file that ride on its own row.
FACTS = ["path", "had_bom", "delimiter", "layout", "primary_dimension", "dimension_label", "dimensions_available",
         "slash_order", "date_assumed"]


def _file_columns() -> list:
    """Of a shaped file: its facts, why it is unusable, and what typing its rows needs."""
    lacks = F.array_compact(F.array(
        F.when(F.col("_cols.date").isNull(), "date"), F.when(F.col("_cols.cost").isNull(), "cost"), F.when(F.size("_dims") == 0, NO_DIMENSION)))
    named = F.concat(F.lit(MISSING_COLUMNS[0]), F.array_join(lacks, ", "), F.lit(MISSING_COLUMNS[1]))
    missing = F.col("_code") == "missing_required_columns"
    message = F.when(missing & (F.col("layout") == "long"), named).when(missing, NO_COST_COLUMNS).otherwise(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in FATAL_MESSAGES.items() for x in kv]), F.col("_code")))
    return [*KEYS, *FACTS, F.col("_code").alias("fatal_code"), message.alias("fatal_message"), F.size("_header").alias("_width"), "_header_line",
            "_cols", "_columns", layouts.first_currency(F.col("_header")).alias("_currency")]


def parse_lines(files: DataFrame, spread: int | None = None) -> DataFrame:
    """The `line` table. files: tenant_id, export_id, path, content.

    With many files each is one unit of work and nothing is shuffled. `spread` distributes the blocks
    of a few large ones over that many tasks instead.
    """
    shaped = _shape(files)
    usable = F.col("_code").isNull()
    own = F.array(F.struct(F.lit(-1).alias("before"), F.lit("").alias("text"), F.lit(True).alias("plain")))
    blocks = F.when(usable, F.concat(own, delimited.numbered_blocks(F.col("_blocks")))).otherwise(own)
    meta = shaped.select(*_file_columns(), F.explode(blocks).alias("_b"))
    if spread:
        meta = meta.repartition(spread)
    is_file = F.col("_b.before") < 0
    numbered = F.when(is_file, F.array(F.struct(F.lit(0).cast("bigint").alias("line"), F.lit("").alias("body")))).otherwise(
        delimited.numbered_records(F.col("_b.before"), F.col("_b.text"), F.col("delimiter"), F.col("_b.plain")))
    rows = meta.select("*", is_file.alias("_file"), F.inline(numbered)).drop("_b")
    rows = rows.where(F.col("_file") | (F.col("line") != F.col("_header_line")))
    # Blank records are dropped before they are split; a filter on the fields would split twice.
    rows = rows.where(F.col("_file") | ~delimited.is_blank(F.col("body"), F.col("delimiter")))
    rows = rows.withColumn("fields", F.when(~F.col("_file"), delimited.split_fields(F.col("body"), F.col("delimiter"))))
    return _typed(rows, FACTS)


def parse_plain(files: DataFrame, without: list[str] | None = None) -> DataFrame:
    """Rows of plain long files (`sources.plain`) as in the `line` table, but for columns `without`, with `earlier` and `differs`.
    A file that is not plain is a row of kind "other" with its contents, for `parse_lines`."""
    head = F.substring_index(F.col("content").cast("string"), "\n", plain.HEAD_LINES).cast("binary")
    shaped = _shape(files.select(*KEYS, "path", F.col("content").alias("_whole"), head.alias("content")))
    schema = plain.schema(without)
    about = shaped.select(*_file_columns(), "_header", "_whole").drop("had_bom", "fatal_message", "_width", "_columns")
    return about.mapInArrow(plain.line_batches(to_arrow_schema(schema)), schema)


def parse_large(lines: DataFrame, whole_profile: bool = False) -> DataFrame:
    """The `line` table of files read line by line (`ranges.physical_lines`), of any size and number of lines.

    Same rows as `parse_lines` gives, without its limits on bytes and lines; a field's length and a record's columns stay
    limited. `whole_profile` judges the delimiter on all lines instead of the first ones."""
    lines = cut(lines)
    checked = ranges.file_checks(lines)
    judged = ranges.profiled_delimiter(lines) if whole_profile else ranges.sampled_delimiter(lines)
    files = checked.join(judged, "path", "left").withColumn("_code", F.coalesce("code", F.when(F.coalesce("lines", F.lit(0)) == 0, "not_delimited")))
    files = cut(files.select(*KEYS, "path", "had_bom", "_code", F.when(F.col("_code").isNull(), F.col("delimiter")).alias("delimiter")))
    usable = files.where("_code IS NULL").select("path", "delimiter")
    d = F.col("delimiter")
    stated = ranges.with_states(lines.join(usable, "path"), d)
    found = cut(ranges.records(stated).join(usable, "path").where(F.col("body").isNull() | ~delimited.is_blank(F.col("body"), d)).withColumn(
        "fields", delimited.split_fields(F.col("body"), d)))
    longest = F.aggregate("fields", F.lit(0), lambda s, f: F.greatest(s, F.length(f)))
    wrong = F.when(F.col("body").isNull() | (longest > MAX_FIELD_CHARS), "malformed_csv").when(F.size("fields") > MAX_COLUMNS, "too_many_columns")
    heads = found.groupBy("path").agg(
        F.min_by("fields", "line").alias("_header"), F.min("line").alias("_header_line"), F.count("*").alias("_records"),
        F.min_by(wrong, F.when(wrong.isNotNull(), F.col("line"))).alias("_bad"))
    led = files.join(heads, "path", "left").withColumn("_code", F.coalesce(
        "_code", "_bad", F.when(F.coalesce("_records", F.lit(0)) == 0, "empty_file").when(F.col("_records") < 2, "no_data_rows")))
    headed = cut(_headed(led.withColumn("_header", F.when(F.col("_code").isNull(), F.col("_header")))))
    # Counts of date cells under both orders take the place of the list of them.
    index = F.when(F.col("_long"), F.col("_cols.date")).otherwise(0)
    dates = found.join(headed.where("_code IS NULL").select("path", "_long", "_cols", F.col("_header_line").alias("_h")), "path").where("line <> _h").select(
        "path", F.get("fields", index).alias("cell"))
    seen = dates.groupBy("path").agg(
        F.bool_or(cells.slash_first(F.col("cell")) > 12).alias("first"), F.bool_or(cells.slash_second(F.col("cell")) > 12).alias("second"),
        F.bool_or(strip(F.col("cell")).rlike(cells.SLASH_DATE)).alias("any"),
        F.count_if(~cells.is_total_label(F.col("cell"))).alias("cells"),
        *[F.count_if(~cells.is_total_label(F.col("cell")) & cells.to_day(F.col("cell"), o).isNotNull()).alias(o) for o in ("dmy", "mdy")])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    order, assumed = cells.slash_order_from(yes("first"), yes("second"), yes("any"))
    dated = headed.join(seen, "path", "left").withColumn("slash_order", order).withColumn("date_assumed", assumed)
    of_order = F.when(F.col("slash_order") == "dmy", F.col("dmy")).otherwise(F.col("mdy"))
    wide = (F.size("_header") >= 2) & (F.col("cells") > 0) & (of_order >= F.greatest(F.lit(1), F.floor(F.col("cells") / F.lit(2)).cast("int")))
    shaped = cut(_laid_out(dated.withColumn("_wide", F.coalesce(wide, F.lit(False)))).select(*_file_columns()))
    own = shaped.select("*", F.lit(True).alias("_file"), F.lit(0).cast("bigint").alias("line"), F.lit("").alias("body"), F.lit(None).cast("array<string>").alias("fields"))
    rows = found.select("path", "line", "body", "fields").join(shaped.where("fatal_code IS NULL"), "path").where("line <> _header_line").withColumn("_file", F.lit(False))
    return _typed(own.unionByName(rows), FACTS)


def _typed(rows: DataFrame, facts: list[str]) -> DataFrame:
    """Fields to typed columns, in steps: a value that later steps use several times is a column first,
    so it is computed once and no step compiles to an oversized method. Judging across rows comes later.
    """
    cols, is_file, comma = F.col("_cols"), F.col("_file"), F.col("_comma")
    at = lambda name: F.when(F.col("_on") & cols[name].isNotNull(), F.get("fields", cols[name]))
    first_cell = F.get("fields", F.lit(0))
    base = rows.withColumns({
        "_comma": F.col("delimiter") == ";", "_long": F.col("layout") == "long",
        "width_ok": F.when(~is_file, F.size("fields") == F.col("_width"))})
    base = base.withColumns({
        "_usable": F.coalesce("width_ok", F.lit(False)), "_on": F.coalesce("width_ok", F.lit(False)) & F.col("_long"),
        "kind": F.when(is_file, "file").when(~F.col("_long") & cells.is_total_label(first_cell), "total").otherwise("data")})
    raw = base.withColumns({
        "_joined": F.when(F.col("_usable"), delimited.joined_fields(F.col("body"), F.col("fields"), F.col("delimiter"))),
        "_date": strip(F.when(F.col("_on"), F.get("fields", cols["date"])).when(F.col("_usable"), first_cell)),
        "_cost": cells.money_text(at("cost"), comma), "_qty": cells.quantity_text(at("usage_quantity"), comma),
        "_end": strip(at("period_end")), "_unit": at("usage_unit"), "_flag": at("partial"),
        "_cur": F.when(F.col("_on"), F.when(
            cols["currency"].isNotNull(), F.upper(clean_label(at("currency")))).otherwise(F.col("_currency"))),
        **{f"_l_{d}": F.when(F.col("_on") & cols[d].isNotNull(), F.coalesce(
            F.nullif(clean_label(at(d)), F.lit("")), F.lit(BLANK_LABEL))) for d in LONG_DIMENSIONS}})
    texts = raw.withColumns({
        "_day": cells.day_text(F.col("_date"), F.col("slash_order")),
        "_end_day": cells.day_text(F.col("_end"), F.col("slash_order")),
        # The columns of a wide export ride in one array, judged cell by cell.
        "_cells": F.when(~F.col("_long") & ~is_file, F.transform("_columns", lambda c: F.struct(
            c["idx"].alias("idx"), c["label"].alias("label"), c["currency"].alias("currency"), c["total"].alias("total"),
            money(F.get("fields", c["idx"]), comma).alias("cell")))),
        "_q": cells.quantity_cell(F.col("_qty"))})
    owner = F.lit(False)
    for d in OWNERSHIP_DIMENSIONS:
        if d in LONG_DIMENSIONS:
            owner = owner | F.coalesce(is_unallocated_label(F.col(f"_l_{d}")) | (F.col(f"_l_{d}") == BLANK_LABEL), F.lit(False))
    named = lambda d: F.col(f"_l_{d}") if d in LONG_DIMENSIONS else F.lit(None).cast("string")
    fact = lambda f: F.col(f) if f == "layout" else F.when(is_file, F.col(f))
    return texts.select(
        *KEYS, "kind", F.when(is_file, F.lit(0)).otherwise(F.col("line")).cast("bigint").alias("line"),
        # Facts of the file ride on its own row only; data rows keep what judging needs.
        *[fact(f).alias(f) for f in facts],
        "fatal_code", F.when(is_file, F.col("fatal_message")).alias("fatal_message"),
        F.when(is_file, F.transform(F.filter("_columns", lambda c: c["currency"].isNotNull()), lambda c: c["currency"])).alias("header_currencies"),
        cols["date"].alias("date_idx"), cols["cost"].alias("cost_idx"), cols["usage_quantity"].alias("quantity_idx"),
        "width_ok", F.unhex(F.md5("_joined")).alias("signature"),
        F.col("_day").try_cast("date").alias("period_start"),
        F.when(F.col("_on"), cells.money_cell(F.col("_cost"))).alias("cost"),
        F.when(F.col("_qty").isNotNull(), F.col("_q")).alias("quantity"),
        F.when(F.coalesce(F.col("_q.status") == "ok", F.lit(False)), clean_label(F.col("_unit"))).alias("unit"),
        F.col("_cur").alias("currency"), *[named(d).alias(d) for d in DIMENSIONS],
        (F.col("_on") & owner).alias("unallocated"),
        F.col("_end_day").try_cast("date").alias("period_end"), F.coalesce(is_true(F.col("_flag")), F.lit(False)).alias("partial"),
        F.col("_cells").alias("cells"),
    )
