"""Long exports of plain text to `line` rows, a file at a time and column by column.

`exports` judges any file cell by cell. Most long exports are printable ASCII with one kind of line end and ISO dates. In
such a file each distinct text of a column is judged once, by the same rules, and rows meet the file's other rows where
they are read: a row knows whether an earlier one repeats it (`earlier`) and whether the accepted row before it with its date
and labels had another cost (`differs`). What a file is, its delimiter, header and layout, is judged by `exports` from its
first lines. Any file for which that could be wrong is handed on whole, as a row of kind "other".
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Callable, Iterator
from datetime import date
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tallyframe.functions.cells import BLANK_LABEL, PLAIN_NUMBER, TRUE_WORDS, UNALLOCATED_LABEL
from tallyframe.schema import (
    COST, DIMENSIONS, LONG_DIMENSIONS, MAX_ABS_COST, MAX_ABS_QUANTITY, MAX_COLUMNS, MAX_FIELD_CHARS, MAX_LINES, OWNERSHIP_DIMENSIONS, QUANTITY,
)

#: Bytes of a plain file; lines its header is judged on; rows passed on at once; digits and characters of a number, and of a cost that needs no rounding or limit.
BYTES = bytes(range(32, 127)) + b"\n"
HEAD_LINES = 200
SLICE = 16_384
MAX_DIGITS, MAX_NUMBER, USUAL_CHARS = 30, 60, 12

_SLASH_DATE = re.compile(r"/(?<=\d/)\d{1,2}/\d{4}", re.ASCII)
_TIME = r"[T ][0-9:.+\-Z]*"
_DAY = re.compile(r"(?!0000)\d{4}-\d{2}-\d{2}", re.ASCII)
_TIMED = re.compile(rf"(\d{{4}}-\d{{2}}-\d{{2}}){_TIME}", re.ASCII)
_MONTH = re.compile(rf"(\d{{4}}-\d{{2}})(?:{_TIME})?", re.ASCII)
_SIGNED = re.compile(r"^(\x00?)\s*([-+]?)\$", re.ASCII)
_PADDED = re.compile(r"^(\x00?)\s+", re.ASCII)
_COMMA = re.compile(r"(\x00?[-+]?\d+),(\d+)", re.ASCII)
_GROUPED = re.compile(r"\x00?[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?", re.ASCII)
_MONEY = re.compile(r"^(?:\x00(?!-[^eE]*[1-9]))?" + PLAIN_NUMBER.removeprefix("^"), re.ASCII)
_NUMBER = re.compile(PLAIN_NUMBER, re.ASCII)
_EXPONENT = re.compile(r"[eE][-+]?\d{4}", re.ASCII)
_USUAL = re.compile(r"\$?(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?", re.ASCII)
_NOBODY = re.compile(UNALLOCATED_LABEL, re.ASCII)
_UNIT = Decimal(1).scaleb(-COST.scale)
_EXACT = Context(prec=100, rounding=ROUND_HALF_UP)
_EPOCH = date(1970, 1, 1).toordinal()


class Other(Exception):
    """The file is not one these rules are known to be right for."""


def _cell(kind: T.DecimalType) -> T.StructType:
    return T.StructType([T.StructField("status", T.StringType()), T.StructField("value", kind)])


_WIDE_CELL = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("total", T.BooleanType()), T.StructField("cell", _cell(COST))])
_TEXT, _LONG, _INT, _BOOL, _DATE = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DateType()

#: Columns of the `line` table, what rows know of their file's others, and the contents of files handed on.
FIELDS: dict[str, T.DataType] = {
    "tenant_id": _TEXT, "export_id": _TEXT, "kind": _TEXT, "line": _LONG, "path": _TEXT, "had_bom": _BOOL, "delimiter": _TEXT, "layout": _TEXT,
    "primary_dimension": _TEXT, "dimension_label": _TEXT, "dimensions_available": T.ArrayType(_TEXT), "slash_order": _TEXT, "date_assumed": _BOOL,
    "fatal_code": _TEXT, "fatal_message": _TEXT, "header_currencies": T.ArrayType(_TEXT), "date_idx": _INT, "cost_idx": _INT, "quantity_idx": _INT,
    "width_ok": _BOOL, "signature": T.BinaryType(), "period_start": _DATE, "cost": _cell(COST), "quantity": _cell(QUANTITY), "unit": _TEXT, "currency": _TEXT,
    **dict.fromkeys(DIMENSIONS, _TEXT), "unallocated": _BOOL, "period_end": _DATE, "partial": _BOOL, "cells": T.ArrayType(_WIDE_CELL),
    "earlier": _BOOL, "differs": _BOOL, "content": T.BinaryType()}
#: Columns of a record that counts, sums and rejections do not read; what nobody asks of a plain row that its file has judged.
LABELS = [*DIMENSIONS, "unit", "unallocated", "period_end", "partial"]


def schema(without: list[str] | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in FIELDS.items() if n not in (without or ())])


def records_of(text: str, delimiter: str) -> tuple[list[list[str]], np.ndarray]:
    """Records and the lines they end on."""
    reader = csv.reader(io.StringIO(text, newline="\n"), delimiter=delimiter)
    try:
        found = list(reader)
        if reader.line_num == len(found):
            return found, np.arange(1, len(found) + 1)
        reader = csv.reader(io.StringIO(text, newline="\n"), delimiter=delimiter)
        found = [(r, reader.line_num) for r in reader]
    except csv.Error as e:
        raise Other from e
    return [r for r, _ in found], np.array([n for _, n in found])


def texts(column: tuple[str, ...]) -> tuple[np.ndarray, list[str]]:
    """(code of each cell, distinct texts by code)."""
    found = list(set(column))
    index = dict(zip(found, range(len(found)), strict=True))
    return np.fromiter(map(index.__getitem__, column), np.int64, len(column)), found


def coded(column: tuple[np.ndarray, list[str]], fn: Callable[[str], object]) -> tuple[np.ndarray, list]:
    """(code of each cell, values by code): fn of every distinct text, equal values under one code."""
    index: dict[object, int] = {}
    codes = np.array([index.setdefault(fn(t), len(index)) for t in column[1]], np.int64)
    return codes[column[0]], list(index)


def together(columns: list[tuple[np.ndarray, list]], n: int) -> np.ndarray:
    """One number a row, equal where all codes are."""
    key, size = np.zeros(n, np.int64), 1
    for codes, values in columns:
        if size * max(1, len(values)) > 1 << 62:
            kinds, key = np.unique(key, return_inverse=True)
            size = len(kinds)
        key, size = key * max(1, len(values)) + codes, size * max(1, len(values))
    return key


def label(raw: str) -> str:
    return raw.replace("\n", " ").strip()


def day(raw: str) -> int | None:
    """Days since 1970 of an ISO date with optional day and time. Files with slash dates are not plain."""
    text = raw.strip()
    if "\n" in text:
        raise Other
    if m := _TIMED.fullmatch(text):
        text = m[1]
    elif m := _MONTH.fullmatch(text):
        text = m[1] + "-01"
    if not _DAY.fullmatch(text):
        return None
    try:
        return date.fromisoformat(text).toordinal() - _EPOCH
    except ValueError:
        return None


def _value(text: str, valid: re.Pattern, kind: T.DecimalType, limit: Decimal) -> tuple[str, Decimal | None]:
    if text == "":
        return "empty", None
    if len(text) > MAX_NUMBER or "\n" in text:
        raise Other
    if not valid.search(text):
        return "invalid", None
    number = text.replace("\x00", "")
    if _EXPONENT.search(number) or len(number) > MAX_DIGITS and sum(ch.isdigit() for ch in number) > MAX_DIGITS:
        raise Other
    value = Decimal(number).quantize(_UNIT, context=_EXACT)
    if abs(value) > limit or abs(value) >= Decimal(10) ** (kind.precision - kind.scale):
        return "out_of_range", None
    return "ok", -value if text.startswith("\x00") else value


def _ungrouped(text: str, comma: bool) -> str:
    if comma and (m := _COMMA.fullmatch(text)):
        text = f"{m[1]}.{m[2]}"
    return text.replace(",", "") if _GROUPED.fullmatch(text) else text


def money(comma: bool) -> Callable[[str], tuple[str, Decimal | None]]:
    def judge(raw: str) -> tuple[str, Decimal | None]:
        text = raw.strip()
        if not comma and len(text) <= USUAL_CHARS and (m := _USUAL.fullmatch(text)):
            return "ok", Decimal(text.lstrip("$").replace(",", ""))
        if len(text) > 1 and text[0] == "(" and text[-1] == ")":
            text = "\x00" + text[1:-1]
        text = _PADDED.sub(r"\1", _SIGNED.sub(r"\1\2", text).strip())
        return _value(_ungrouped(text, comma), _MONEY, COST, MAX_ABS_COST)
    return judge


def quantity(comma: bool) -> Callable[[str], tuple[str, Decimal | None]]:
    return lambda raw: _value(_ungrouped(raw.strip(), comma), _NUMBER, QUANTITY, MAX_ABS_QUANTITY)


def nobody(text: str | None) -> bool:
    return text is not None and (text == BLANK_LABEL or _NOBODY.search(text) is not None)


def _body(text: str, file: dict) -> tuple[list[list[str]], np.ndarray]:
    """Records below the header that are not blank, with their lines."""
    if "/" in text and _SLASH_DATE.search(text):
        raise Other
    lines = text.count("\n") + (not text.endswith("\n"))
    found, ends = records_of(text, file["delimiter"])
    # A quote left open takes the text's last line end into its field.
    if lines > MAX_LINES or not found or found[-1] and "\n" in found[-1][-1]:
        raise Other
    single = len(found) == lines
    if not single or max(map(len, text.split("\n"))) >= MAX_COLUMNS - 1:
        if any(len(r) > MAX_COLUMNS or max(map(len, r), default=0) > MAX_FIELD_CHARS for r in found):
            raise Other
    blank = [i for i, r in enumerate(found) if not r or not r[0].strip() and not "".join(r).strip()]
    if blank:
        raw = text.split("\n")
        # A blank record with a quote is blank or not by rules of its own.
        if any('"' in raw[ends[i] - 1] or any("\n" in f for f in found[i]) for i in blank):
            raise Other
        keep = np.ones(len(found), bool)
        keep[blank] = False
        found, ends = [r for i, r in enumerate(found) if keep[i]], ends[keep]
    if len(found) < 2 or found[0] != file["_header"] or ends[0] != file["_header_line"]:
        raise Other
    return found[1:], ends[1:]


def typed(text: str, file: dict, names: list[str]) -> dict[str, tuple[np.ndarray, list] | np.ndarray]:
    """Columns `names` of the file's data rows: (code of each row or -1 for null, values), or an array of the values."""
    data, lines = _body(text, file)
    n, width, at, comma = len(data), len(file["_header"]), file["_cols"], file["delimiter"] == ";"
    right = np.fromiter(map(len, data), np.int64, n) == width
    good = np.flatnonzero(right)
    columns = list(zip(*(data if len(good) == n else [data[i] for i in good]), strict=True)) or [()] * width
    distinct = [texts(c) for c in columns]
    out: dict = {"line": lines, "width_ok": right}

    def cells(field: str, fn: Callable[[str], object]) -> tuple[np.ndarray, list]:
        return coded(distinct[at[field]], fn)

    def spread(codes: np.ndarray, values: list) -> tuple[np.ndarray, list]:
        full = np.full(n, -1)
        full[good] = codes
        return full, values

    days, costs = cells("date", day), cells("cost", money(comma))
    out["period_start"], out["cost"] = spread(*days), spread(*costs)
    same = together([coded(c, str.strip) for c in distinct], len(good))
    first, place = np.unique(same, return_index=True, return_inverse=True)[1:]
    again = first[place] < np.arange(len(good))
    out["earlier"] = np.zeros(n, bool)
    out["earlier"][good[again]] = True
    labels = {d: cells(d, lambda raw: label(raw) or BLANK_LABEL) for d in LONG_DIMENSIONS if at[d] is not None}
    use = ~again & np.array([v is not None for v in days[1]] or [False])[days[0]] & np.array([v[0] == "ok" for v in costs[1]] or [False])[costs[0]]
    kept = np.flatnonzero(use)
    key = together([days, *labels.values()], len(good))[kept]
    order = np.argsort(key, kind="stable")
    key, cost = key[order], costs[0][kept][order]
    out["differs"] = np.zeros(n, bool)
    out["differs"][good[kept[order[1:][(key[1:] == key[:-1]) & (cost[1:] != cost[:-1])]]]] = True
    if at["usage_quantity"] is not None:
        amounts = cells("usage_quantity", quantity(comma))
        out["quantity"] = spread(*amounts)
        if "unit" in names and at["usage_unit"] is not None:
            codes, values = cells("usage_unit", label)
            out["unit"] = spread(np.where(np.array([v[0] == "ok" for v in amounts[1]] or [False])[amounts[0]], codes, -1), values)
    if at["currency"] is not None:
        out["currency"] = spread(*cells("currency", lambda raw: label(raw).upper()))
    elif file["_currency"] is not None:
        out["currency"] = spread(np.zeros(len(good), np.int64), [file["_currency"]])
    if "service" in names:
        out |= {d: spread(*v) for d, v in labels.items()}
        owner = np.zeros(n, bool)
        for d in OWNERSHIP_DIMENSIONS:
            if d in labels:
                owner[good] |= np.array([nobody(v) for v in labels[d][1]] or [False])[labels[d][0]]
        out["unallocated"] = owner
        if at["period_end"] is not None:
            out["period_end"] = spread(*cells("period_end", day))
        flags = np.zeros(n, bool)
        if at["partial"] is not None:
            codes, values = cells("partial", lambda raw: raw.strip().lower() in TRUE_WORDS)
            flags[good] = np.array(values or [False])[codes]
        out["partial"] = flags
    if "signature" in names:
        marks = [hashlib.md5("\0".join(map(str.strip, r)).encode(), usedforsecurity=False).digest() for r in zip(*columns, strict=True)]
        out["signature"] = spread(np.arange(len(good)), marks)
    return out


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays(
            [pa.array([v[0] for v in values], pa.string()), pa.array([v[1] for v in values], kind.field("value").type)], fields=[kind.field(i) for i in range(2)])
    if pa.types.is_date(kind):
        return pa.array(values, pa.int32()).cast(kind)
    return pa.array(values, kind)


def _file_row(file: dict) -> dict[str, object]:
    """What is true of a file that is usable, or of one that is handed on."""
    facts = {k: file[k] for k in ("path", "delimiter", "primary_dimension", "dimension_label", "dimensions_available", "slash_order", "date_assumed")}
    return {**facts, "kind": "file", "line": 0, "had_bom": False, "unallocated": False, "partial": False, "earlier": False, "differs": False}


def batches_of(file: dict, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The `line` rows of one file, its own row first; or the file itself, if it is not plain."""
    keys = {k: file[k] for k in ("tenant_id", "export_id")}
    content = file.pop("_whole")
    try:
        usable = file["fatal_code"] is None and file["layout"] == "long" and None not in (content, *keys.values()) and not content.translate(None, BYTES)
        if not usable:
            raise Other
        found = typed(content.decode("ascii"), file, arrow.names)
    except Other:
        yield pa.RecordBatch.from_pylist([{**keys, "path": file["path"], "kind": "other", "content": content}], arrow)
        return
    at, own = file["_cols"], _file_row(file)
    fixed = {**keys, "layout": "long", "date_idx": at["date"], "cost_idx": at["cost"], "quantity_idx": at["usage_quantity"]}
    yield pa.RecordBatch.from_pylist([{k: v for k, v in {**fixed, **own}.items() if k in arrow.names}], arrow)
    values = {k: _array(v[1], arrow.field(k).type) for k, v in found.items() if isinstance(v, tuple) and k in arrow.names}
    n = len(found["line"])
    for start in range(0, n, SLICE):
        stop = min(start + SLICE, n)
        columns = []
        for f in arrow:
            v = found.get(f.name)
            if isinstance(v, tuple):
                codes = v[0][start:stop]
                columns.append(values[f.name].take(pa.array(codes, pa.int64(), mask=codes < 0)))
            elif v is not None:
                columns.append(pa.array(v[start:stop], f.type))
            else:
                one = "data" if f.name == "kind" else fixed.get(f.name)
                columns.append(pa.nulls(stop - start, f.type) if one is None else pa.repeat(pa.scalar(one, f.type), stop - start))
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)


def line_batches(arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from batches_of(batch.slice(i, 1).to_pylist()[0], arrow)
    return run
