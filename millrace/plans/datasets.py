"""Whole jobs: building a training set, analysing tokens, comparing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, compare, messages, pairing, ranking, stats
from ..session import ship_package
from ..sources import readers, writers


def build_training_set(spark: SparkSession, tasks: str, labels: str, prompt: str | None, out: str, ratio: float = 0.05, seed: int = 42, exact_shuffle: bool = False) -> dict[str, int]:
    """Read, pair, project, split and write ``train`` and ``validation`` below ``out``; the counts."""
    ship_package(spark)
    left = readers.read_task_records(spark, tasks)
    right = readers.read_labels(spark, labels).drop("pos")
    if left.isEmpty() and right.isEmpty():
        raise checks.DataError("no records")
    paired = pairing.pair_one_to_one(left, right, "id")
    system = readers.read_prompt(spark, prompt) if prompt else ""
    rows = messages.sft_rows(paired, "id", "body", "label", system or None)
    placed = rows.join(left.select("id", "pos"), "id")
    split = ranking.split_by_shuffle(placed, "id", "pos", ratio, seed) if exact_shuffle else ranking.split_by_hash(placed, "id", ratio, seed)
    counts = {}
    for name, want in (("train", False), ("validation", True)):
        part = split.where(F.col("is_validation") == want).orderBy("pos").select("id", "messages", "enable_thinking")
        counts[name] = writers.write_parquet(writers.with_required(part, ["id", "messages", "enable_thinking"]), f"{out}/{name}", files=1)
    return counts


def build_test_set(spark: SparkSession, records: DataFrame, prompt: str | None, size: str = "2x2") -> DataFrame:
    """``records(pos, record)``, JSON texts, as prompts of one size with ids by place."""
    checks.gate(records.where(~checks.task_record_ok("record")), "bad record", ["pos"])
    chosen = checks.size_filter(records.withColumn("size", F.get_json_object("record", "$.size")), "size", size)
    if chosen.isEmpty():
        raise checks.DataError(f"no record of size {size}")
    rows = messages.numbered_rows(chosen, ["pos"])
    system = F.lit(prompt) if prompt else None
    return rows.select("id", messages.chat_messages(F.col("record"), None, system).alias("messages"), F.lit(False).alias("enable_thinking"))


def analyse_tokens(rows: DataFrame, context_length: int | None = None, minimum: int = 0, alignment: int = 256) -> dict[str, DataFrame]:
    """``rows(split, id, prompt_tokens, assistant_tokens, total_tokens)``: summary by split, recommended length, longest rows, violations."""
    from ..functions.text import align_up

    best = rows.agg(F.max("total_tokens").alias("observed")).select("observed", F.greatest(F.lit(minimum).cast("long"), align_up(F.col("observed"), alignment)).alias("recommended"))
    return {
        "splits": stats.token_report(rows, ["prompt_tokens", "assistant_tokens", "total_tokens"]),
        "length": best,
        "longest": ranking.longest(rows, "total_tokens", ["split", "id"]),
        "violations": checks.context_violations(rows, "total_tokens", context_length) if context_length is not None else rows.limit(0),
    }


SETTINGS = ["model_path", "data_file", "max_model_len", "max_new_tokens", "enable_thinking", "seed"]


def compare_runs(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], key: str = "correct", samples: int = 1000, settings: list[str] | None = None) -> dict[str, DataFrame]:
    """Two (rows, summary) results with the same settings and questions: transitions, changed rows, rates, an interval."""
    names = SETTINGS if settings is None else settings
    checks.gate(pairing.differing_settings(before[1], after[1], names), "settings differ")
    pairs = pairing.before_after(before[0], after[0], "index", ["question", "reference"], [key])
    b, a = f"before_{key}", f"after_{key}"
    difference = pairs.select("index", (F.col(a).cast("int") - F.col(b).cast("int")).alias("d"))
    return {
        "transitions": compare.transitions(pairs, b, a), "changed": compare.turned(pairs, "index", b, a), "rates": compare.rates(pairs, b, a),
        "interval": compare.bootstrap_by_hash(difference, "index", "d", samples),
    }
