"""Delimited text to records, fields and line numbers: column expressions over one row per file.

A file is bounded (25 MB, a million lines), so everything that needs the whole file, such as its
delimiter, header and date order, is decided inside its own row: no shuffle between scan and rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.bind import let
from tallyframe.functions.cells import WHITESPACE, strip
from tallyframe.schema import MAX_COLUMNS, MAX_FIELD_CHARS, MAX_LINES
from tallyframe.sources.landing import DELIMITERS

NEWLINE = r"\r\n|\n|\r"
#: Lines for the delimiter sample also end at the rarer separators.
SAMPLE_NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SAMPLE_LINES = 50
BLOCK = 1024


def _quoted(delimiter: str) -> str:
    return {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)


def field_pattern(delimiter: str) -> str:
    """One field. A quote opens a quoted field only at its start; doubled quotes stay inside it; text
    after the closing quote belongs to the field; an unclosed quote runs to the end."""
    d = _quoted(delimiter)
    return rf'(?:"(?:[^"]++|"")*+(?:"|\z)[^{d}\r\n]*+|(?!")[^{d}\r\n]*+)'


def record_pattern(delimiter: str) -> str:
    f = field_pattern(delimiter)
    return rf"{f}(?:{_quoted(delimiter)}{f})*+(?:{NEWLINE}|\z)"


def blank_pattern(delimiter: str) -> str:
    """A record whose fields are all whitespace."""
    ws = "".join(ch for ch in WHITESPACE if ch != delimiter)
    f = rf'(?:[{ws}]*+|"[{ws}]*+")'
    return rf"\A{f}(?:{_quoted(delimiter)}{f})*+(?:{NEWLINE})?\z"


def by_delimiter(delimiter: Column, build: Callable[[str], Column]) -> Column:
    """CASE over the four delimiters, so every pattern is a compiled constant."""
    out = F.when(delimiter == DELIMITERS[0], build(DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        out = out.when(delimiter == d, build(d))
    return out


def _unquote(field: Column) -> Column:
    inner = F.regexp_extract(field, r'(?s)\A"((?:[^"]++|"")*+)', 1)
    rest = F.regexp_replace(field, r'(?s)\A"(?:[^"]++|"")*+"?', "")
    return F.when(field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(field)


def split_fields(body: Column, delimiter: Column) -> Column:
    """Fields of one record without its line end. Records without a quote take the plain split."""
    def build(d: str) -> Column:
        quoted = F.transform(
            F.regexp_extract_all(F.concat(F.lit(d), body), F.lit(f"{_quoted(d)}({field_pattern(d)})"), F.lit(1)), _unquote)
        return F.when(body.contains('"'), quoted).otherwise(F.split(body, _quoted(d), -1))
    return by_delimiter(delimiter, build)


def without_newline(record: Column) -> Column:
    cut = lambda n: F.substr(record, F.lit(1), F.length(record) - n)
    return (F.when(record.endswith("\r\n"), cut(2))
            .when(record.endswith("\n") | record.endswith("\r"), cut(1)).otherwise(record))


def records_of(text: Column, delimiter: Column, plain: Column | None = None) -> Column:
    """Records with their line ends, or without them in text that has no quote or is known to be `plain`: no line end
    is inside quotes. The empty match at the end of the text is dropped; blank records are still there."""
    found = by_delimiter(delimiter, lambda d: F.regexp_extract_all(text, F.lit(record_pattern(d)), F.lit(0)))
    lines = F.when(text.contains("\r"), F.split(text, NEWLINE, -1)).otherwise(F.split(text, "\n", -1))
    whole = text.contains('"') if plain is None else ~plain & text.contains('"')
    return F.when(whole, F.filter(found, lambda r: r != "")).when(
        text.rlike(r"[\r\n]\z"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def is_blank(record: Column, delimiter: Column) -> Column:
    return by_delimiter(delimiter, lambda d: record.rlike(blank_pattern(d)))


def sample_text(text: Column) -> Column:
    """The first lines that are not blank, the sample delimiters are judged on."""
    head = F.regexp_extract(text, rf"\A(?:(?:(?!{SAMPLE_NEWLINE})[\s\S])*+(?:{SAMPLE_NEWLINE}|\z)){{0,{SAMPLE_LINES}}}+", 0)
    lines = F.filter(F.slice(F.split(head, SAMPLE_NEWLINE), 1, SAMPLE_LINES), lambda x: strip(x) != "")
    return F.array_join(lines, "\n")


def sample_widths(sample: Column, delimiter: str) -> Column:
    d = F.lit(delimiter)
    return F.transform(records_of(sample, d), lambda r: F.size(split_fields(without_newline(r), d)))


def profile_delimiter(widths: list[Column]) -> Column:
    """struct(lines, width, delimiter) that splits the sample most consistently.

    Per delimiter: the most frequent width (first seen wins a tie), scored by its frequency when it
    is above one, then by the width; the earlier delimiter wins a tie. Zero lines means undelimited.
    """
    def best(rank: int) -> Column:
        mode = let(widths[rank], lambda seen: F.array_max(F.transform(F.array_distinct(seen), lambda w, i: F.struct(
            F.size(F.filter(seen, lambda x: x == w)).alias("n"), (-i).alias("seen"), w.alias("w")))))
        return F.struct(F.when(mode["w"] > 1, mode["n"]).otherwise(0).alias("lines"),
                        F.coalesce(mode["w"], F.lit(0)).alias("width"), F.lit(-rank).alias("order"),
                        F.lit(DELIMITERS[rank]).alias("delimiter"))

    return F.array_max(F.array(*[best(i) for i in range(len(DELIMITERS))]))


def blocks_of(text: Column, delimiter: Column) -> Column:
    """The text cut after every BLOCK records. Whole-file work then runs over a few hundred strings
    instead of an array of every record; all blocks but the last hold exactly BLOCK records."""
    found = by_delimiter(delimiter, lambda d: F.regexp_extract_all(
        text, F.lit(f"(?:(?!\\z)(?:{record_pattern(d)})){{1,{BLOCK}}}+"), F.lit(0)))
    # Without quotes a record is a line, and cutting after a number of lines is much cheaper.
    lines = F.regexp_extract_all(text, F.lit(rf"(?:[^\r\n]*+(?:{NEWLINE})){{1,{BLOCK}}}+|[^\r\n]++\z"), F.lit(0))
    return F.filter(F.when(text.contains('"'), found).otherwise(lines), lambda b: b != "")


def line_ends(text: Column) -> Column:
    """Number of line ends; plain byte counting where the text only uses one kind."""
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.contains("\r"), F.regexp_count(text, F.lit(NEWLINE))).otherwise(feeds)


def oversize_code(blocks: Column, delimiter: Column) -> Column:
    """First limit a record breaks: an oversized field, too many columns, or too many lines."""
    def code(r: Column) -> Column:
        fields = split_fields(without_newline(r), delimiter)
        return (F.when(F.exists(fields, lambda f: F.length(f) > MAX_FIELD_CHARS), "malformed_csv")
                .when(F.size(fields) > MAX_COLUMNS, "too_many_columns"))

    def first_bad(b: Column, i: Column) -> Column:
        # A record can only break a limit with a long line, or with line ends inside its fields.
        several = (line_ends(b) != BLOCK) & b.contains('"')
        marks = F.transform(records_of(b, delimiter), lambda r, j: F.when(
            F.length(r) >= MAX_COLUMNS, F.struct((i * BLOCK + j).alias("at"), code(r).alias("code"))))
        # Line after line from the start, so that a line is passed over once.
        long_line = b.rlike(rf"\A(?:[^\r\n]{{0,{MAX_COLUMNS - 2}}}+[\r\n])*+[^\r\n]{{{MAX_COLUMNS - 1}}}")
        return F.when(long_line | several,
                      F.get(F.filter(marks, lambda m: m["code"].isNotNull()), F.lit(0)))

    bad = F.get(F.filter(F.transform(blocks, first_bad), lambda m: m.isNotNull()), F.lit(0))
    lines = F.aggregate(blocks, F.lit(0), lambda s, b: s + line_ends(b)) + F.when(
        F.element_at(blocks, -1).rlike(r"[\r\n]\z"), 0).otherwise(1)
    return (F.when(bad["at"] < MAX_LINES, bad["code"]).when(lines > MAX_LINES, "too_many_rows").otherwise(bad["code"]))


def _extra(record: Column) -> Column:
    """Line ends inside one record's quoted fields."""
    return F.when(record.contains('"'), line_ends(without_newline(record))).otherwise(0)


def extra_lines(records: Column) -> Column:
    return F.aggregate(records, F.lit(0), lambda s, r: s + _extra(r))


def numbered_blocks(blocks: Column) -> Column:
    """array<struct(before, text, plain)>: blocks with the physical line before each, ready to explode. A block before
    the last holds BLOCK records; with as many line ends none of these is inside quotes, and it is plain."""
    return let(F.transform(blocks, line_ends), lambda ends: F.transform(blocks, lambda b, i: F.struct(
        F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0), lambda s, e: s + e).alias("before"), b.alias("text"),
        ((i + 1 < F.size(ends)) & (F.get(ends, i) == BLOCK)).alias("plain"))))


def numbered_records(before: Column, text: Column, delimiter: Column, plain_text: Column) -> Column:
    """array<struct(line, body)>: each record of a block with the line it ends on.

    Quoted line ends make a line depend on the records before it; they are summed within the block,
    and only in a block that has any.
    """
    def plain(r: Column, i: Column) -> Column:
        return F.struct((before + i + 1).cast("bigint").alias("line"), without_newline(r).alias("body"))

    def number(records: Column) -> Column:
        def shifted(r: Column, i: Column) -> Column:
            inside = extra_lines(F.slice(records, F.lit(1), i + 1))
            return F.struct((before + i + 1 + inside).cast("bigint").alias("line"), without_newline(r).alias("body"))
        several = ~plain_text & text.contains('"') & (line_ends(text) > F.size(records))
        return F.when(several, F.transform(records, shifted)).otherwise(F.transform(records, plain))
    return let(records_of(text, delimiter, plain_text), number)


def joined_fields(body: Column, fields: Column, delimiter: Column) -> Column:
    """Trimmed fields joined by NUL, which cannot occur in accepted text. A record without quotes or
    padding only has its delimiters replaced (not by `translate`, which drops characters that become NUL)."""
    ws = "".join(ch for ch in WHITESPACE if ch != "\t")
    plain = ~body.contains('"') & ~body.rlike(rf"[{ws}](?:[,;\t|]|\z)|(?:\A|[,;\t|])[{ws}]|(?:\A|\t)\t|\t\z")
    return F.when(plain, by_delimiter(
        delimiter, lambda d: F.replace(body, F.lit(d), F.lit("\x00")))).otherwise(F.array_join(F.transform(fields, strip), "\x00"))
