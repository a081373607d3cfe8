"""Splits, top-k, probes and batches."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import DataError

SPLIT_MULTIPLE = 32


def validation_size(n: int, ratio: float, multiple: int = SPLIT_MULTIPLE) -> int:
    """Rows of a validation split: the nearest multiple, halves up, with at least one multiple on either side."""
    if not 0 <= ratio < 1:
        raise DataError("the ratio is in [0, 1)")
    if ratio == 0:
        return 0
    if n < 2 * multiple:
        raise DataError(f"a split needs {2 * multiple} rows")
    wanted = int(n * ratio + multiple / 2) // multiple * multiple
    return min(max(multiple, wanted), (n - multiple) // multiple * multiple)


def _hash_order(id_column: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.lit(str(seed))))


def take_smallest(df: DataFrame, key: Column, tie: str, k: int, flag: str) -> DataFrame:
    """Marks exactly the k rows with the least (key, tie), without sorting all rows in one task.

    The k-th key is found among counts of four-digit prefixes: only the prefix
    bucket that holds it is ranked, a 65536th of the rows.
    """
    if k <= 0:
        return df.withColumn(flag, F.lit(False))
    keyed = df.withColumn("_key", key).withColumn("_head", F.substring("_key", 1, 4))
    heads = df.select(F.substring(key, 1, 4).alias("_head")).groupBy("_head").agg(F.count(F.lit(1)).alias("n"))  # at most 65536 rows
    ahead = heads.withColumn("before", F.sum("n").over(Window.orderBy("_head")) - F.col("n"))
    cut = ahead.where((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).first()
    if cut is None:
        return df.withColumn(flag, F.lit(True))
    edge = keyed.where(F.col("_head") == cut["_head"]).withColumn("_rank", F.row_number().over(Window.orderBy("_key", tie)))
    inside = keyed.where(F.col("_head") != cut["_head"]).withColumn("_rank", F.lit(0))
    last = k - cut["before"]
    both = inside.unionByName(edge)
    chosen = (F.col("_head") < cut["_head"]) | ((F.col("_head") == cut["_head"]) & (F.col("_rank") <= last))
    return both.withColumn(flag, chosen).drop("_key", "_head", "_rank")


def split_by_hash(df: DataFrame, id_column: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``is_validation``: exactly the aligned number of rows, those with the least hash of id and seed."""
    return take_smallest(df, _hash_order(id_column, seed), id_column, validation_size(df.count(), ratio), "is_validation")


def split_by_shuffle(df: DataFrame, id_column: str, order: str, ratio: float, seed: int = 42) -> DataFrame:
    """The same sizes with membership from a seeded Mersenne-Twister shuffle of the ids in file order.

    That sequence exists on one machine only, so the ids come to the driver; for corpora use ``split_by_hash``.
    """
    ids = [r[0] for r in df.select(id_column, order).orderBy(order).collect()]
    size = validation_size(len(ids), ratio)
    random.Random(seed).shuffle(ids)
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    chosen = spark.createDataFrame([(i,) for i in ids[:size]], f"_id {kind}").withColumn("_in", F.lit(True))
    return df.join(chosen, F.col(id_column) == F.col("_id"), "left").withColumn("is_validation", F.col("_in").isNotNull()).drop("_id", "_in")


def holdout(df: DataFrame, id_column: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``is_validation`` for exactly ceil(n * ratio) rows."""
    n = df.count()
    size = -int(-n * ratio // 1)
    return take_smallest(df, _hash_order(id_column, seed), id_column, size, "is_validation")


def longest(df: DataFrame, length: str, ties: list[str], k: int = 10) -> DataFrame:
    """The k longest rows: a heap in each task, then one of the winners."""
    return df.orderBy(F.desc(length), *ties).limit(k)


def memory_probe(df: DataFrame, id_column: str, length: str, pool: int, rows: int) -> DataFrame:
    """``rows`` rows that cycle through the ``pool`` longest, with ids that tell their number."""
    if pool <= 0 or rows <= 0:
        raise DataError("pool and rows are positive")
    top = longest(df, length, [id_column], pool)
    ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(length), id_column)) - 1).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy()))
    each = ranked.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).where(F.col("probe") % F.col("_size") == F.col("_rank"))
    return each.withColumn(id_column, F.format_string("%s__oom_probe_%04d", F.col(id_column).cast("string"), "probe")).drop("_rank", "_size")


def batches(df: DataFrame, order: list[str], size: int, group: list[str] | None = None) -> DataFrame:
    """Adds ``batch``: consecutive chunks of ``size`` rows, per group where given."""
    w = (Window.partitionBy(*group) if group else Window).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def latency_per_row(df: DataFrame, batch: list[str], latency: str) -> DataFrame:
    return df.withColumn("row_latency", F.col(latency) / F.count(F.lit(1)).over(Window.partitionBy(*batch)))
