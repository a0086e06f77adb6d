"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is known about it
but its outputs: successive prefixes of a conversation are rendered, and consecutive outputs are
compared. If each output begins with the one before, the new part is the turn's span; two probe texts
rendered in the turn's place show which part of the span is the text itself. If an output does not
begin with the one before, the template rewrites history: the turn where this happens is reported,
and no loss mask is given, since spans found earlier would be wrong.

Turns are ordered by turn number (nulls first), role and text, so ties and repeated rows have one
order; each row is a turn. Null texts and roles are empty. A null conv_id is one conversation. An
empty table gives no rows. A conversation is one row of the result and is put together in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, read

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Probe texts: they share no first and no last character, and no template marks either.
PROBES = ("\x01\x02", "\x03\x04")


@lru_cache(1 << 16)
def _escaped(text: str) -> str:
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def _unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


_COLON = "\\:"


def plain_template(turns: list[Turn]) -> str:
    """`### role: text </turn>` lines; a backslash stands before each backslash, # and < inside role and text
    (and each colon of a role), so that no text contains a mark and the escaping can be undone."""
    return "".join(f"### {_escaped(role).replace(':', _COLON)}: {_escaped(text)} </turn>\n" for role, text in turns)


def forgetful_template(turns: list[Turn]) -> str:
    """As plain_template, but it drops what assistants said before the last user turn: it rewrites history."""
    last = max((i for i, (role, _) in enumerate(turns) if role == "user"), default=-1)
    return plain_template([(role, "" if role == "assistant" and i < last else text) for i, (role, text) in enumerate(turns)])


_BLOCK = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)", re.S)


def read_back(formatted: str) -> list[Turn]:
    """The turns of plain_template's output."""
    return [(_unescaped(m[1]), _unescaped(m[2])) for m in map(_BLOCK.fullmatch, formatted.split(" </turn>\n")[:-1]) if m]


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def render(turns: list[Turn], template: Template = plain_template, loss_role: str = "assistant") -> dict:
    """formatted, spans [(start, end, text start, text end)] of the turns, mask [(start, end)] under the
    loss, and rewritten_at: the first turn whose coming changed earlier output, or None."""
    before, spans = template([]), []
    margins: dict[str, tuple[int, int]] = {}
    for k, (role, _) in enumerate(turns):
        now = template(turns[:k + 1])
        if not now.startswith(before):
            return {"formatted": template(turns), "spans": [], "mask": [], "rewritten_at": k}
        if role not in margins or k < 2:  # the first turn may differ from later ones
            one, two = (template([*turns[:k], (role, p)]) for p in PROBES)
            head = _shared(one, two)
            margins[role] = head - len(before), _shared(one[head:][::-1], two[head:][::-1])
        head, tail = margins[role]
        spans.append((len(before), len(now), len(before) + head, len(now) - tail))
        before = now
    mask = [(s[2], s[3]) for (role, _), s in zip(turns, spans, strict=True) if role == loss_role]
    return {"formatted": before, "spans": spans, "mask": mask, "rewritten_at": None}


SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "text_start", "text_end")])
RESULT = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)),
                       T.StructField("mask", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                       T.StructField("rewritten_at", T.LongType())])
_SPAN = pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")])
_RESULT = pa.struct([("formatted", pa.string()), ("spans", pa.list_(_SPAN)), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rewritten_at", pa.int64())])


def format_conversations(turns: DataFrame, template: Template = plain_template, loss_role: str = "assistant", out: str = "chat") -> DataFrame:
    """conv_id and a struct `out` for each conversation."""
    whole = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    grouped = whole.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(conversations: pa.Array) -> pa.Array:
        rows = []
        for conversation in conversations.to_pylist():
            done = render([(t["role"], t["text"]) for t in conversation], template, loss_role)
            rows.append(done | {"spans": [dict(zip(("start", "end", "text_start", "text_end"), s, strict=True)) for s in done["spans"]],
                                "mask": [{"start": a, "end": b} for a, b in done["mask"]]})
        return pa.array(rows, _RESULT)

    return append_column(grouped, out, RESULT, "turns", run).select("conv_id", out)


DIGEST = T.StructType([T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                       T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text and its mask finds."""
    def run(chats: pa.Array) -> pa.Array:
        rows = []
        for chat in chats.to_pylist():
            text = chat["formatted"]
            turns = read_back(text)
            loss = "".join(_unescaped(text[m["start"]:m["end"]]) for m in chat["mask"])
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append({"n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss),
                         "loss_sha256": sha(loss), "formatted_chars": len(text)})
        return pa.array(rows, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return append_column(formatted, "digest", DIGEST, "chat", run).select("conv_id", "digest.*", F.col("chat.rewritten_at").isNotNull().alias("rewrites_history"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(control)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')))::BIGINT AS formatted_chars,
       false AS rewrites_history
FROM c GROUP BY conv_id
"""
