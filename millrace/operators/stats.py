"""Exact statistics: percentiles, run reports, reward groups.

Percentiles are exact. Those of groups of any size narrow ranges of values
(``selection.select_ranks``); the one-row reports of a run aggregate value
counts map-side, so a task holds distinct values (token counts, latencies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import middle, nearest, ranks_beside, rounded, select_ranks


def nearest_rank(column: str, q: float, kind: str = "bigint") -> Column:
    """The value at rank ceil(n * q), at least 1; null over no rows."""
    return F.expr(f"cast(percentile_disc({q}) within group (order by {column}) as {kind})")


def length_summary(column: str, prefix: str = "") -> list[Column]:
    """min, p50, p90, p95, p99, max."""
    return [
        F.min(column).alias(f"{prefix}min"), *(nearest_rank(column, q).alias(f"{prefix}p{round(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)),
        F.max(column).alias(f"{prefix}max"),
    ]


def numeric_summary(column: str, prefix: str = "") -> list[Column]:
    """min, p50, p95, max, avg as doubles; nulls over no rows."""
    d = lambda c: c.cast("double")
    return [
        d(F.min(column)).alias(f"{prefix}min"), nearest_rank(column, 0.5, "double").alias(f"{prefix}p50"),
        nearest_rank(column, 0.95, "double").alias(f"{prefix}p95"), d(F.max(column)).alias(f"{prefix}max"), d(F.avg(column)).alias(f"{prefix}avg"),
    ]


def rounded_rank_percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """``share, value``: the value at index round((n - 1) * share) of the sorted rows, halves to even; by narrowing ranges."""
    chosen = select_ranks(df, column, {repr(float(s)): rounded(float(s)) for s in shares})
    return chosen.select(F.col("name").cast("double").alias("share"), "value")


def group_medians(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """``group..., median``: cut to an integer: of two middle values the mean without its fraction."""
    middles = ranks_beside(df, df.groupBy(*group).agg(F.count(column).alias("_n")), column, middle(), group)
    return middles.select(*group, F.floor((F.col("low") + F.col("high")) / 2).cast("long").alias("median"))


def length_report(df: DataFrame, column: str, group: list[str]) -> DataFrame:
    """``group..., count, min, p50, p90, p95, p99, max`` of a length, for many groups at once."""
    base = df.groupBy(*group).agg(F.count(F.lit(1)).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"))
    ranks = {f"p{round(q * 100)}": nearest(q) for q in (0.5, 0.9, 0.95, 0.99)}
    return ranks_beside(df, base, column, ranks, group, "long").select(*group, "count", "min", *ranks, "max")


def numeric_report(df: DataFrame, column: str, group: list[str]) -> DataFrame:
    """``group..., min, p50, p95, max, avg`` as doubles."""
    d = lambda c, name: c.cast("double").alias(name)
    base = df.groupBy(*group).agg(d(F.min(column), "min"), d(F.max(column), "max"), d(F.avg(column), "avg"))
    return ranks_beside(df, base, column, {"p50": nearest(0.5), "p95": nearest(0.95)}, group, "double").select(*group, "min", "p50", "p95", "max", "avg")


def first_longest(df: DataFrame, index: str, length: str) -> DataFrame:
    """The first row of the greatest length, by min over pairs; no sort."""
    return df.agg(F.min(F.struct((-F.col(length)).alias("less"), F.col(index).alias("at"))).alias("m")).select(F.col("m.at").alias(index), (-F.col("m.less")).alias(length))


def token_report(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Per split the count and the summary of each length column, in one aggregation."""
    parts = [c for name in columns for c in length_summary(name, f"{name}_")]
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("count"), *parts)


def run_report(df: DataFrame, wall_ms: float, ok="ok", latency="latency_ms", prompt="prompt_tokens", completion="completion_tokens") -> DataFrame:
    """One row: quality, latency, token and throughput figures of a generation run."""
    seconds = wall_ms / 1000
    rate = lambda c: (c.cast("double") / seconds) if seconds > 0 else F.lit(None).cast("double")
    total, good = F.count(F.lit(1)), F.count_if(F.col(ok))
    return df.agg(
        total.alias("total"), good.alias("success"), (total - good).alias("failed"),
        F.when(total > 0, good / total).otherwise(F.lit(0.0)).alias("success_rate"),
        *numeric_summary(latency, "latency_"), *numeric_summary(prompt, "prompt_"), *numeric_summary(completion, "completion_"),
        F.lit(seconds).alias("wall_seconds"), rate(total).alias("requests_per_second"), rate(good).alias("successful_per_second"),
        rate(F.coalesce(F.sum(completion), F.lit(0))).alias("tokens_per_second"),
    )


def failure_counts(df: DataFrame, ok: str = "ok", kind: str = "error_type") -> DataFrame:
    return df.where(~F.col(ok) & (F.length(kind) > 0)).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def evaluation_summary(df: DataFrame) -> DataFrame:
    """One row: counts and rates of the scoring flags."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("bigint")).alias("correct"), share("correct").alias("accuracy"),
        share("format_valid").alias("format_rate"), share("strict_correct").alias("strict_accuracy"),
        F.avg("completion_tokens").alias("mean_tokens"), share("truncated").alias("truncation_rate"),
    )


#: Fixed: keeps the advantage finite where a group has no spread.
ADVANTAGE_EPSILON = 1e-6


def group_advantage(df: DataFrame, group: list[str], reward: str) -> DataFrame:
    """Reward against its group: (r - mean) / (sample deviation + epsilon); 0 where all rewards agree.

    The groups' two moments are aggregated map-side and joined back, so a large group is not sorted in one task.
    """
    stats = df.groupBy(*group).agg(F.avg(reward).alias("_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_dev"), F.min(reward).eqNullSafe(F.max(reward)).alias("_flat"))
    out = df.join(stats, group).withColumn(
        "advantage", F.when(F.col("_flat"), F.lit(0.0)).otherwise((F.col(reward) - F.col("_mean")) / (F.col("_dev") + ADVANTAGE_EPSILON))
    )
    return out.drop("_mean", "_dev", "_flat")


def flat_groups(df: DataFrame, group: list[str], reward: str) -> DataFrame:
    """One row a group: its size, mean reward, and whether it teaches nothing."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean_reward"), (F.min(reward) == F.max(reward)).alias("flat"), (F.min(reward) >= 1).alias("all_correct")
    )


def shares_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's sum and its share of all."""
    per = df.groupBy(key).agg(F.sum(value).alias("total"))
    return per.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def extrapolate_hours(mean_seconds: float, steps: int) -> float:
    return mean_seconds * steps / 3600
