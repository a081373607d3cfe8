"""Row checks. Each gives columns or the offending rows; ``gate`` turns offenders into an error on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_fence, has_think_tag, is_blank, is_valid_id


class DataError(ValueError):
    """The first violation, as an error."""


def gate(violations: DataFrame, what: str, order: list[str] | None = None) -> None:
    """Raise DataError for the first offending row, if any; only that row reaches the driver."""
    ranked = violations.orderBy(*order) if order else violations
    if first := ranked.limit(1).collect():
        raise DataError(f"{what}: {first[0].asDict(recursive=True)}")


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise DataError(f"missing columns: {', '.join(missing)}")
    return df


def id_check(df: DataFrame, column: str = "id") -> DataFrame:
    return df.withColumn("id_ok", is_valid_id(F.col(column)))


def duplicate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Ids that occur more than once, with their counts, by partial aggregation."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def label_checks(df: DataFrame, column: str) -> DataFrame:
    """Which labels hold reasoning tags, fences or nothing."""
    c = F.col(column)
    return df.withColumns({"think_tag": has_think_tag(c), "fenced": has_fence(c), "blank": is_blank(c)})


CARD_ROLES, MATH_ROLES, PROMPT_ROLES = ("user,assistant", "system,user,assistant"), ("user,assistant",), ("system,user",)


def role_signature(messages: str = "messages") -> Column:
    return F.array_join(F.transform(messages, lambda m: m["role"]), ",")


def messages_ok(messages: str = "messages", roles=CARD_ROLES, marker: str | None = None, no_think: bool = True) -> Column:
    """Allowed role order, no blank content, no reasoning tag and, for answers that need it, a marker in the last message."""
    ok = role_signature(messages).isin(*roles) & F.forall(messages, lambda m: ~is_blank(F.coalesce(m["content"], F.lit(""))))
    last = F.element_at(messages, -1)["content"]
    if marker:
        ok = ok & last.contains(marker)
    if no_think:
        ok = ok & ~has_think_tag(last)
    return F.coalesce(ok, F.lit(False))


def inference_input_ok(id_column: str = "id", messages: str = "messages", thinking: str = "enable_thinking", size: str = "2x2") -> Column:
    """System and user message, a safe id, thinking off, and a JSON object of the wanted size as the user's content."""
    spec = F.try_parse_json(F.element_at(messages, 2)["content"])
    return F.coalesce(
        F.col(id_column).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & role_signature(messages).isin(*PROMPT_ROLES) & ~F.col(thinking)
        & (F.try_variant_get(spec, "$.size", "string") == size),
        F.lit(False),
    )


#: Fixed: the fields of a task record and the sizes it may ask for.
TASK_FIELDS = ("assetCandidates", "dataModelSchema", "eventCandidates", "size", "userQuery")
SIZES = ("2x2", "2x4")


def task_record_ok(text: str) -> Column:
    """A JSON object with exactly the task fields, a query that is not blank, a known size and the right containers."""
    v = F.try_parse_json(F.col(text))
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.coalesce(
        (F.array_sort(F.json_object_keys(F.col(text))) == F.array(*map(F.lit, TASK_FIELDS)))
        & ~is_blank(F.try_variant_get(v, "$.userQuery", "string")) & F.try_variant_get(v, "$.size", "string").isin(*SIZES)
        & kind("dataModelSchema").startswith("OBJECT") & kind("eventCandidates").startswith("ARRAY") & kind("assetCandidates").startswith("ARRAY"),
        F.lit(False),
    )


def size_filter(df: DataFrame, column: str, size: str = "2x2") -> DataFrame:
    return df.where(F.col(column) == size)


def non_negative(column: str) -> Column:
    return F.coalesce(F.col(column) >= 0, F.lit(False))


def finite_positive(column: str) -> Column:
    c = F.col(column).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")) & (c > 0), F.lit(False))


def context_violations(df: DataFrame, tokens: str, limit: int) -> DataFrame:
    """Rows longer than the model's context, pushed down as a filter."""
    return df.where(F.col(tokens) > limit)


def prompt_is_prefix(prompt: str, full: str) -> Column:
    """The full token row starts with the prompt's and goes on."""
    n = F.size(prompt)
    return (F.size(full) > n) & (F.slice(full, F.lit(1), n) == F.col(prompt))


def capacity(df: DataFrame, prompt_tokens: str, new_tokens: int, limit: int) -> DataFrame:
    """One row: the longest prompt, what it needs with the answer, whether that fits."""
    need = F.max(prompt_tokens) + new_tokens
    return df.agg(F.max(prompt_tokens).alias("longest_prompt"), need.alias("needed"), (need <= limit).alias("fits"))


def first_violation(df: DataFrame, bad: Column, order: str) -> DataFrame:
    """The offending row that comes first in the given order."""
    return df.where(bad).orderBy(order).limit(1)


def duplicates_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """Later rows of a repeated id, as a reader that stops at the first repeat would meet them."""
    w = Window.partitionBy(column).orderBy(order)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")
