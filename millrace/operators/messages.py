"""Chat rows: building, encoding and scoring them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_number, final_answer, strip
from .ordinals import with_ordinal


def chat_messages(user: Column, assistant: Column | None = None, system: Column | None = None) -> Column:
    """An array of role and content; a part that is null or missing is left out."""
    parts = [(r, c) for r, c in (("system", system), ("user", user), ("assistant", assistant)) if c is not None]
    row = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in parts))
    return F.filter(row, lambda m: m["content"].isNotNull())


def sft_rows(df: DataFrame, id_column: str, task: str, label: str, system: str | None = None) -> DataFrame:
    """``id, messages, enable_thinking`` of training rows."""
    return df.select(
        F.col(id_column).alias("id"), chat_messages(F.col(task), strip(F.col(label)), F.lit(system) if system else None).alias("messages"),
        F.lit(False).alias("enable_thinking"),
    )


def numbered_rows(df: DataFrame, order: list[str], prefix: str = "taskspec-") -> DataFrame:
    """Ids by place, from 001, in as many tasks as the rows need."""
    numbered = with_ordinal(df, order, "_number", 1)
    return numbered.withColumn("id", F.format_string(f"{prefix}%03d", "_number")).drop("_number")


def question_messages(question: Column, answer: Column, instruction: str) -> Column:
    return chat_messages(F.concat_ws(" ", strip(question), F.lit(instruction)), strip(answer))


def score_answers(df: DataFrame, generation: str, reference: str, finish_reason: str) -> DataFrame:
    """Prediction and the flags of an evaluation row; null predictions are wrong, not unknown."""
    prediction = final_answer(F.col(generation))
    out = df.withColumn("prediction", prediction).withColumn("expected", canonical_number(F.col(reference)))
    return out.withColumns(
        {
            "format_valid": F.col(generation).contains("####") & F.col("prediction").isNotNull(),
            "correct": F.coalesce(F.col("prediction") == F.col("expected"), F.lit(False)),
            "truncated": F.col(finish_reason).eqNullSafe("length"),
        }
    ).withColumn("strict_correct", F.col("correct") & F.col("format_valid"))


def word_token_ids(text: Column) -> Column:
    """Deterministic ids of white-space words, natively: CRC-32 of each."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def tokenizer_column(tokenize, text: Column) -> Column:
    """Any text-to-ids function as an Arrow function, for real tokenizers."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else normal_ids(tokenize(v)) for v in values.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(text)


def normal_ids(found) -> list[int]:
    """Flat ids from what tokenizers return: a list, a list of one list, an array, or a mapping with input_ids."""
    if isinstance(found, dict) or hasattr(found, "keys"):
        found = found["input_ids"]
    flat = np.asarray(found)
    if flat.ndim == 2 and len(flat) == 1:
        flat = flat[0]
    if flat.ndim != 1:
        raise ValueError("token ids of one text are one row")
    return flat.astype(int).tolist()


def apply_template(messages: str = "messages", generation_prompt: bool = False) -> Column:
    """The whole conversation as text in a plain role-tagged template."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n")) if generation_prompt else body


def encode_example(df: DataFrame, prompt_ids: str, full_ids: str, max_length: int) -> DataFrame:
    """``input_ids, position_ids, loss_mask`` and whether the row fits; rows are never cut."""
    n, p = F.size(full_ids), F.size(prompt_ids)
    return df.withColumns(
        {
            "input_ids": F.col(full_ids),
            "position_ids": F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            "loss_mask": F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), n - p)),
            "too_long": n > max_length,
        }
    )


def seeded_tokenizer(text: str) -> list[int]:
    """A stand-in where no vocabulary is at hand: one id a word."""
    return [zlib.crc32(w.encode()) for w in text.split()]
