"""Text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without Unicode white space and the separators U+001C to U+001F at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_BLANKS}+|{_BLANKS}+$", "")


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def is_valid_id(value: Column) -> Column:
    """There, not blank and without white space at the ends; never null."""
    return F.coalesce(value.isNotNull() & (F.length(value) > 0) & (value == strip(value)), F.lit(False))


def has_think_tag(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("<think>") | low.contains("</think>")


def has_fence(text: Column) -> Column:
    """Three backticks at the start or the end."""
    return text.startswith("```") | text.endswith("```")


#: The fixed pattern of a number in an answer.
NUMBER = r"-?(?:\d[\d,]*(?:\.\d+)?|\.\d+)"


def final_answer(text: Column) -> Column:
    """The last number after the last ``####``, or in the whole text if there is none; null if no number is there."""
    tail = F.substring_index(text, "####", -1)
    return canonical_number(F.try_element_at(F.regexp_extract_all(tail, F.lit(rf"(?U){NUMBER}"), F.lit(0)), F.lit(-1)))


def canonical_number(raw: Column) -> Column:
    """Plain decimal notation without commas, needless zeros or a negative zero.

    Decimal arithmetic rounds at 28 significant digits; longer numbers are
    rounded half to even at that place, in the same notation.
    """
    for pattern, to in (
        (",", ""), (r"(\.\d*?)0+$", "$1"), (r"\.$", ""), (r"^(-?)0+([0-9])", "$1$2"), (r"^-?0?$", "0"), (r"^(-?)\.", "$10."),
    ):
        raw = F.regexp_replace(raw, pattern, to)
    return F.when(F.length(raw) > 28, _let(raw, _rounded)).otherwise(raw)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rounded(plain: Column) -> Column:
    """A number of more than 28 significant digits at 28, from its digits: one up if the rest is over half, or half after an odd digit."""
    every = F.regexp_replace(plain, r"[-.]", "")
    lead = F.length(every) - F.length(F.regexp_replace(every, "^0+", ""))
    whole = F.length(F.regexp_replace(F.substring_index(plain, ".", 1), "-", ""))
    sign = F.when(plain.startswith("-"), F.lit("-")).otherwise(F.lit(""))

    def cut(x: Column) -> Column:
        head, tail = F.substr(x["every"], F.lit(1), x["lead"] + 28), F.substr(x["every"], x["lead"] + 29)
        half = F.rpad(F.lit("5"), F.length(tail), "0")
        up = (tail > half) | ((tail == half) & head.rlike("[13579]$"))
        raised = head.cast("decimal(38,0)") + F.when(up, F.lit(1)).otherwise(F.lit(0))
        return F.struct(x["sign"].alias("sign"), F.length(x["every"]).alias("n"), x["whole"].alias("whole"), F.length(head).alias("k"), raised.cast("string").alias("raised"))

    def place(x: Column) -> Column:
        digits = F.lpad(x["raised"], F.greatest(x["k"], F.length(x["raised"])), "0")
        return F.struct(x["sign"].alias("sign"), (x["whole"] + F.length(digits) - x["k"]).alias("whole"), F.rpad(digits, x["n"] + F.length(digits) - x["k"], "0").alias("digits"))

    def told(x: Column) -> Column:
        text = F.concat(x["sign"], F.substr(x["digits"], F.lit(1), x["whole"]), F.lit("."), F.substr(x["digits"], x["whole"] + 1))
        return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")

    row = F.struct(sign.alias("sign"), every.alias("every"), lead.alias("lead"), whole.alias("whole"))
    return F.when(F.length(every) - lead > 28, _let(_let(_let(row, cut), place), told)).otherwise(plain)


def align_up(value: Column, step: int) -> Column:
    """The least multiple of ``step`` that is not below ``value``."""
    return (F.ceil(value / step) * step).cast("long")


#: Fixed palette of gradients by index; the first two bytes of the seed's SHA-256 choose.
PALETTE_SIZE = 8


def palette_index(seed: Column) -> Column:
    return (F.conv(F.substring(F.sha2(seed, 256), 1, 4), 16, 10).cast("long") % PALETTE_SIZE).cast("int")


def classify_failure(finish_reason: Column, text: Column, error: Column) -> Column:
    """What went wrong with a completion, the most telling reason first."""
    return (
        F.when(finish_reason == "length", "truncated")
        .when(text.isNull() | is_blank(text), "empty")
        .when(error.isNotNull(), "conversion_error")
        .otherwise("unknown")
    )


def format_metric(value: Column, whole: bool = False) -> Column:
    """Integers as they are, other numbers with two places, null as n/a."""
    told = value.cast("string") if whole else F.format_string("%.2f", value.cast("double"))
    return F.when(value.isNull(), F.lit("n/a")).otherwise(told)


def format_percent(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f%%", value.cast("double") * 100))
