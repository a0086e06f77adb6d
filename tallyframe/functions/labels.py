"""Safety of customer-written labels: masking, withholding, environment class, notable reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.cells import strip

# ---- fixed values: masks, withheld wording and environment words --------------------------------
ACCOUNT_ID = r"(?<!\d)\d{12}(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?i)https?://|www\."
INSTRUCTION = (
    r"(?i)\b(ignore|disregard|override|forget)\b.{0,40}\b(instructions?|previous|prior|above|rules?)\b"
    r"|\binstruction|\bprompt\b|\byou are\b|\bclassif|\brespond\b|\banswer\b"
    r"|\b(escalate|investigate|request[_ ]evidence)\b"
)
FORMULA_STARTS = ["=", "+", "@"]
NON_PRODUCTION = r"stag|dev|test|qa|sandbox|uat|demo|preview|lab"
MAX_PACKET_LABEL = 80
ALIAS_PREFIX = {"account": "acct", "tag": "tag_value", "cost_category": "category_value", "other": "group"}
#: Below this a low-confidence note says something about one finding rather than about all of them.
NOTABLE_BELOW = 0.35


def masked(label: Column) -> Column:
    """Twelve-digit ids and e-mail addresses replaced, over the whole text."""
    return strip(F.regexp_replace(F.regexp_replace(label, ACCOUNT_ID, "<account-id>"), EMAIL, "<email>"))


def must_withhold(masked_label: Column) -> Column:
    """Instruction-like text, links and spreadsheet formulas."""
    return (masked_label.rlike(INSTRUCTION) | masked_label.rlike(URL)
            | F.substring(masked_label, 1, 1).isin(FORMULA_STARTS))


def environment_class(label: Column) -> Column:
    text = F.lower(strip(label))
    return (F.when(text.rlike(NON_PRODUCTION), "non-production").when(text.contains("prod"), "production")
            .otherwise("unknown"))


def alias_text(dimension: Column, number: Column) -> Column:
    prefixes = F.create_map(*[F.lit(x) for kv in ALIAS_PREFIX.items() for x in kv])
    return F.concat(F.try_element_at(prefixes, dimension), F.lit("_"), F.format_string("%02d", number))


def notable_reasons(codes: Column, confidence: Column) -> Column:
    """Reasons that single a finding out: the constant one goes, weak-confidence ones need proof."""
    weak = F.coalesce(confidence < NOTABLE_BELOW, F.lit(False))
    return F.filter(codes, lambda c: (c != "model_requested_review") & (~c.startswith("low_confidence:") | weak))
