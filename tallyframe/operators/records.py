"""From the `line` table to cost records, rejections, conflicts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.cells import is_unallocated_label
from tallyframe.schema import COST_RECORD, DIMENSIONS, KEYS, OWNERSHIP_DIMENSIONS, RECONCILE_TOLERANCE

WIDE = "cost_explorer_wide"
#: Lines per slice when neighbours are compared; bounds a window's group whatever the key's share.
SLICE = 65_536


def data_lines(lines: DataFrame) -> DataFrame:
    """Data rows below the header of usable files."""
    return lines.where((F.col("kind") == "data") & F.col("fatal_code").isNull())


def first_copies(rows: DataFrame) -> DataFrame:
    """Signatures that occur more than once, with their first line. Folded map-side, so a row copied
    a million times arrives as one partial per task."""
    return (
        rows.where(F.col("signature").isNotNull()).groupBy(*KEYS, "signature")
        .agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    )


def previous_in(rows: DataFrame, keys: list[str], value: Column, order: str = "line") -> DataFrame:
    """Adds `previous`: `value` of the previous row with the same keys, in file order.

    Rows are compared within slices of the file; the last value before each slice is carried over
    from the slice summaries. No window ever holds more rows of a key than one slice.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col(order) / SLICE)).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_slice").orderBy(order)
    ends = sliced.groupBy(*keys, "_slice").agg(F.max_by("_value", order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    outer = Window.partitionBy(*keys).orderBy("_slice")
    carried = ends.withColumn("_carried", F.lag("_last").over(outer)).where(F.col("_carried").isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_carried")
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        sliced.withColumn("_inside", F.lag("_value").over(inner))
        .join(carried, same, "left")
        .withColumn("previous", F.coalesce("_inside", "_carried"))
        .drop("_slice", "_value", "_inside", "_carried", "_s", *[f"_k{i}" for i in range(len(keys))])
    )


def settled(lines: DataFrame) -> DataFrame:
    """Rows of files whose rows have met each other where they were read (`sources.plain`): no other row is needed to judge them."""
    return lines.where(F.col("earlier").isNotNull())


def unsettled(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("earlier").isNull()).drop("earlier", "differs")


def _long_judged(rows: DataFrame, again: Column) -> DataFrame:
    cost = F.col("cost.status")
    reason = (
        F.when(~F.col("width_ok"), "field_count_mismatch")
        .when(again, "duplicate_row")
        .when(F.col("period_start").isNull(), "invalid_date")
        .when(cost == "empty", "missing_cost").when(cost == "invalid", "invalid_number").when(cost == "out_of_range", "out_of_range")
    )
    return (
        rows.withColumn("reject_reason", reason)
        .withColumn("reject_col", F.when(F.col("reject_reason") == "invalid_date", F.col("date_idx") + 1)
                    .when(F.col("reject_reason").isin("missing_cost", "invalid_number", "out_of_range"), F.col("cost_idx") + 1))
        .withColumn("conflict", F.lit(None).cast("boolean"))
    )


def classify_settled(lines: DataFrame) -> DataFrame:
    """`classify_rows` of settled rows: each by itself."""
    return _long_judged(data_lines(lines), F.col("earlier")).drop("earlier")


def classify_rows(lines: DataFrame) -> DataFrame:
    """Data rows with `reject_reason` and `reject_col`, checks in the documented order.

    Long: field count, duplicate of any earlier row, date, cost. Wide: field count, date, repeat of the
    previous row of the same period; its cells are judged one by one afterwards.
    """
    if "earlier" in lines.columns:
        return classify_rows(unsettled(lines)).unionByName(classify_settled(settled(lines)), allowMissingColumns=True)
    rows = data_lines(lines)
    long_rows = rows.where(F.col("layout") == "long")
    # Repeated signatures, one short row each, are hashed task by task; the rows pass by unsorted, so sorting spills none of them.
    judged = long_rows.join(first_copies(long_rows).hint("shuffle_hash"), [*KEYS, "signature"], "left")
    long_done = _long_judged(judged, F.col("line") > F.col("first_line")).drop("first_line")
    wide_rows = rows.where(F.col("layout") == WIDE)
    comparable = F.col("width_ok") & F.col("period_start").isNotNull()
    # Only comparable rows see each other: the others sit in a group of their own line.
    group = F.when(comparable, F.lit(-1)).otherwise(F.col("line"))
    seen = previous_in(wide_rows.withColumn("_group", group), [*KEYS, "period_start", "_group"], F.hex("signature"))
    repeat = F.coalesce(comparable & (F.col("previous") == F.hex("signature")), F.lit(False))
    wide_done = (
        seen.withColumn("reject_reason", F.when(~F.col("width_ok"), "field_count_mismatch")
                        .when(F.col("period_start").isNull(), "invalid_date").when(repeat, "duplicate_row"))
        .withColumn("reject_col", F.when(F.col("reject_reason") == "invalid_date", F.lit(1)))
        .withColumn("conflict", comparable & F.col("previous").isNotNull() & ~repeat)
        .drop("_group", "previous")
    )
    return long_done.unionByName(wide_done)


def judged(rows: DataFrame) -> DataFrame:
    """Of classified rows what counts, sums and rejections need. Labels and other dates of a row, most of its bytes, are
    then neither moved to its first copy nor sorted."""
    return rows.select(
        *KEYS, "line", "layout", "period_start", "reject_reason", "reject_col", "conflict", "cost", "currency",
        F.col("quantity.status").alias("quantity_status"), "quantity_idx", "cells", *[c for c in rows.columns if c == "differs"])


def keyed_costs(lines: DataFrame) -> DataFrame:
    """Costs of accepted long rows under a digest of all their dimensions, made before rows meet their first copies."""
    keyed = lines.withColumn("_key", F.when(F.col("layout") == "long", key_digest(lines)))
    return accepted_long(classify_rows(keyed)).select(*KEYS, "period_start", "_key", "line", F.col("cost.value").alias("cost"))


def accepted_long(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("layout") == "long") & F.col("reject_reason").isNull())


def wide_cells(rows: DataFrame) -> DataFrame:
    """One row per value cell of every accepted wide row (the total column is not one)."""
    accepted = rows.where((F.col("layout") == WIDE) & F.col("reject_reason").isNull())
    return accepted.select(*KEYS, "line", "period_start", F.explode(F.filter("cells", lambda c: ~c["total"])).alias("c")).select(
        *KEYS, "line", "period_start", F.col("c.idx").alias("idx"), F.col("c.label").alias("label"),
        F.col("c.currency").alias("currency"), F.col("c.cell.status").alias("status"), F.col("c.cell.value").alias("value"))


def long_records(rows: DataFrame) -> DataFrame:
    return accepted_long(rows).select(
        *KEYS, "period_start", F.trunc("period_start", "month").alias("month"), *DIMENSIONS,
        F.col("cost.value").alias("cost"), "currency", "line", F.lit(None).cast("int").alias("col"), "unallocated",
        F.col("quantity.value").alias("quantity"), "unit", "period_end", "partial")


def wide_records(rows: DataFrame, file_facts: DataFrame) -> DataFrame:
    """Unpivot of the value columns; an empty cell is absent, an unreadable one is rejected elsewhere."""
    about = file_facts.select(*KEYS, F.col("primary_dimension").alias("_dim"))
    values = wide_cells(rows).where(F.col("status") == "ok").join(about, KEYS)
    dims = [F.when(F.col("_dim") == d, F.col("label")).alias(d) for d in DIMENSIONS]
    return values.select(
        *KEYS, "period_start", F.trunc("period_start", "month").alias("month"), *dims, F.col("value").alias("cost"),
        "currency", "line", (F.col("idx") + 1).cast("int").alias("col"),
        (F.col("_dim").isin(OWNERSHIP_DIMENSIONS) & is_unallocated_label(F.col("label"))).alias("unallocated"),
        F.lit(None).cast("decimal(38,15)").alias("quantity"), F.lit(None).cast("string").alias("unit"),
        F.lit(None).cast("date").alias("period_end"), F.lit(False).alias("partial"))


def cost_records(rows: DataFrame, file_facts: DataFrame) -> DataFrame:
    return long_records(rows).unionByName(wide_records(rows, file_facts)).select(*COST_RECORD.fieldNames())


def amounts(rows: DataFrame, file_facts: DataFrame) -> DataFrame:
    """What cost records amount to, of judged rows: cost and currency, and the column for a wide cell."""
    wide = wide_cells(rows).where(F.col("status") == "ok").join(file_facts.select(*KEYS), KEYS)
    return accepted_long(rows).select(*KEYS, F.lit(None).cast("int").alias("col"), F.col("cost.value").alias("cost"), "currency").unionByName(
        wide.select(*KEYS, (F.col("idx") + 1).cast("int").alias("col"), F.col("value").alias("cost"), "currency"))


def rejections(rows: DataFrame) -> DataFrame:
    """Every rejected line or cell of judged rows: position and reason, never content. `scope` says which it is."""
    reason, quantity = F.col("reject_reason"), F.col("quantity_status").isin("invalid", "out_of_range")
    entry = lambda why, col, lines, cells: F.struct(
        why.alias("reason"), col.cast("int").alias("col"), F.lit(lines).alias("lines"), cells.alias("cells"))
    one, none = F.lit(1), F.lit(0)
    # An unreadable cost counts as a rejected line and as a rejected cell.
    line = F.when(reason.isNotNull(), F.array(entry(reason, F.col("reject_col"), 1, F.when(reason.isin("invalid_number", "out_of_range"), one).otherwise(none))))
    amount = F.when((F.col("layout") == "long") & quantity, F.array(entry(F.lit("invalid_number"), F.col("quantity_idx") + 1, 0, one)))
    bad = lambda c: ~c["total"] & c["cell"]["status"].isin("invalid", "out_of_range")
    values = F.when((F.col("layout") == WIDE) & F.exists("cells", bad), F.transform(F.filter("cells", bad), lambda c: entry(
        F.when(c["cell"]["status"] == "invalid", "invalid_number").otherwise("out_of_range"), c["idx"] + 1, 0, one)))
    some = reason.isNotNull() | ((F.col("layout") == "long") & quantity) | ((F.col("layout") == WIDE) & F.exists("cells", bad))
    return rows.where(some).select(*KEYS, "line", F.inline(F.coalesce(line, amount, values))).select(*KEYS, "line", "reason", "col", "lines", "cells")


def sample_rejections(rejected: DataFrame, n: int = 50) -> DataFrame:
    """First `n` per export in file order; each map task keeps at most `n` before the shuffle."""
    order = Window.partitionBy(*KEYS).orderBy("line", F.coalesce("col", F.lit(0)), "reason")
    return rejected.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select(*KEYS, "line", "reason", "col")


def key_digest(rows: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[d for d in DIMENSIONS if d in rows.columns])))


def conflicting_keys(records: DataFrame) -> DataFrame:
    """Long: accepted rows whose cost differs from the previous row of the same date and dimensions."""
    return conflicting_costs(records.where(F.col("col").isNull()).withColumn("_key", key_digest(records)).select(
        *KEYS, "period_start", "_key", "line", "cost"))


def conflicting_costs(keyed: DataFrame) -> DataFrame:
    """Rows of `keyed_costs` whose cost differs from the previous row of the same date and key, counted."""
    seen = previous_in(keyed, [*KEYS, "period_start", "_key"], F.col("cost"))
    return seen.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("cost"))).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("count"))


def differing(rows: DataFrame) -> DataFrame:
    """The same of judged rows that were settled where they were read."""
    return rows.where(F.col("reject_reason").isNull() & F.col("differs")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("count"))


def conflicting_periods(rows: DataFrame) -> DataFrame:
    """Wide: periods that appear again with different values."""
    return rows.where(F.col("conflict")).groupBy(*KEYS).agg(F.count_distinct("period_start").alias("count"))


def reconcile(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Stated totals of a wide export that differ from the accepted values by more than a cent."""
    cells = wide_cells(rows)
    zero = F.lit(0).cast("decimal(38,15)")
    ok = F.when(F.col("status") == "ok", F.col("value"))
    line_sums = cells.groupBy(*KEYS, "line").agg(F.coalesce(F.sum(ok), zero).alias("summed"))
    accepted = rows.where((F.col("layout") == WIDE) & F.col("reject_reason").isNull())
    # The last total column of a row is the stated one.
    total_cell = F.get(F.reverse(F.filter("cells", lambda c: c["total"])), F.lit(0))
    stated_lines = accepted.select(*KEYS, "line", total_cell["cell"]["value"].alias("stated")).where(F.col("stated").isNotNull())
    off = F.abs(F.col("stated") - F.col("summed")) > F.lit(RECONCILE_TOLERANCE)
    bad_lines = stated_lines.join(line_sums, [*KEYS, "line"]).where(off).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("count"))
    last_total = lines.where((F.col("kind") == "total") & F.col("fatal_code").isNull()).groupBy(*KEYS).agg(
        F.max_by("cells", "line").alias("cells"))
    stated_cols = last_total.select(*KEYS, F.explode(F.filter("cells", lambda c: ~c["total"])).alias("c")).select(
        *KEYS, F.col("c.idx").alias("idx"), F.col("c.cell.value").alias("stated")).where(F.col("stated").isNotNull())
    col_sums = cells.groupBy(*KEYS, "idx").agg(F.sum(ok).alias("_sum"))
    bad_cols = (
        stated_cols.join(col_sums, [*KEYS, "idx"], "left").withColumn("summed", F.coalesce("_sum", zero))
        .where(off).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("count"))
    )
    return bad_lines.unionByName(bad_cols).groupBy(*KEYS).agg(F.sum("count").alias("count"))
