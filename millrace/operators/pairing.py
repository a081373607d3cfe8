"""Joins that pair records one to one, zip by place, and test membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import gate


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys without a partner."""
    a = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return a.unionByName(right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def pair_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, and in one side only, from one full outer join."""
    a, b = left.select(F.col(key).alias("a")), right.select(F.col(key).alias("b"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only")
    )


def pair_one_to_one(left: DataFrame, right: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Inner join after the gate: no key without a partner, in the left side's order if one is named."""
    gate(unmatched(left, right, key), "unmatched", ["side", key])
    out = left.join(right, key)
    return out.orderBy(order) if order else out


def before_after(before: DataFrame, after: DataFrame, key: str, equal: list[str], keep: list[str]) -> DataFrame:
    """Two runs row by row: ``before_x`` and ``after_x`` of ``keep``; keys and the ``equal`` columns must agree."""
    gate(unmatched(before, after, key), "keys differ", [key])
    cols = [*equal, *keep]
    a = before.select(key, *(F.col(c).alias(f"before_{c}") for c in cols))
    b = after.select(key, *(F.col(c).alias(f"after_{c}") for c in cols))
    both = a.join(b, key)
    for c in equal:
        gate(both.where(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))), f"{c} differs", [key])
    return both.orderBy(key)


def differing_settings(one: DataFrame, other: DataFrame, fields: list[str]) -> DataFrame:
    """``field``: settings of two one-row tables that are not equal, null equal to null."""
    a, b = one.select(*(F.col(f).alias(f"a_{f}") for f in fields)).limit(1), other.select(*(F.col(f).alias(f"b_{f}") for f in fields)).limit(1)
    told = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    return a.crossJoin(b).select(F.explode(told).alias("field"))  # one row against one row


def zip_by_place(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Rows with one ordinal side by side; every ordinal must have both."""
    return pair_one_to_one(left, right, place)


def missing_members(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in the allowed table: unlisted assets, events, paths."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_anti")


def _prefixes(path: str) -> Column:
    """The path's own prefixes that end before a slash, and itself."""
    upto = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    return F.array_distinct(F.element_at(F.transform(F.array(F.split(F.col(path), "/")), upto), 1))


def cover_by_prefix(paths: DataFrame, roots: DataFrame, case: list[str], path: str = "path", root: str = "root") -> DataFrame:
    """Each path with its longest covering root, null if none covers it.

    A root covers itself and what follows it after a slash. Every prefix of a
    path is looked up, so this is an equi-join on (case, prefix), not a nested loop.
    """
    each = paths.select(*case, path, F.explode(_prefixes(path)).alias(root))
    hit = each.join(roots.select(*case, root).distinct(), [*case, root]).groupBy(*case, path).agg(F.max(F.struct(F.length(root).alias("n"), F.col(root))).alias("m"))
    return paths.join(hit, [*case, path], "left").select(paths["*"], F.col(f"m.{root}").alias("covering_root"))


def unused_roots(paths: DataFrame, roots: DataFrame, case: list[str], path: str = "path", root: str = "root") -> DataFrame:
    used = cover_all(paths, roots, case, path, root)
    return roots.join(used.select(*case, root).distinct(), [*case, root], "left_anti")


def cover_all(paths: DataFrame, roots: DataFrame, case: list[str], path: str = "path", root: str = "root") -> DataFrame:
    """All (path, root) pairs in which the root covers the path."""
    return paths.select(*case, path, F.explode(_prefixes(path)).alias(root)).join(roots.select(*case, root).distinct(), [*case, root])


def reverse_lookup(df: DataFrame, value: str, tokens: DataFrame) -> DataFrame:
    """Adds ``token``: the first token, by ``ord``, that stands for the value; aliases lose."""
    first = tokens.groupBy("value").agg(F.min_by("token", "ord").alias("token"))
    return df.join(first, df[value] == first["value"], "left").drop(first["value"])


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return unmatched(left.select(key).distinct(), right.select(key).distinct(), key)


def ordered_distinct(array: Column) -> Column:
    """Each value once, at its first place."""
    return F.array_distinct(array)
