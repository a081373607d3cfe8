"""Global places of rows: range partitions, counts per partition, and their running sum.

No window runs over all rows. Rows are range-partitioned and sorted, written
once, and counted per partition; what lies ahead of a partition plus the place
inside it is the ordinal. The only window runs over one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder
from .checks import DataError

#: A row's number from ``monotonically_increasing_id`` is its partition times this, plus its place there.
_PARTITION_ROWS = 1 << 33


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, and there if an executor is lost."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "pos", start: int = 0, group: list[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with the long ``name``: each row's place by ``order``, from ``start``, in its ``group`` where one is named.

    The same numbers as ``row_number`` over that order (null first where the
    order says no other). Rows that tie are spread over partitions by a hash of
    their columns and numbered in its order; rows alike in every column are
    interchangeable. A column ``name`` that is there already is replaced. The
    numbered rows are a written table, so that both passes see the same
    partitions even if an executor is lost.
    """
    df = df.drop(name)
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]  # these two have no hash
    sort = [*map(F.col, group), *order, F.xxhash64(*plain)]
    ranged = df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)
    placed = ranged.sortWithinPartitions(*sort).select(*df.columns, F.monotonically_increasing_id().alias("_row"))
    placed = written(placed.withColumns({"_part": F.expr(f"_row div {_PARTITION_ROWS}"), "_row": F.col("_row") % _PARTITION_ROWS}))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    ahead = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    out = placed.join(F.broadcast(ahead), F.col("_part") == F.col("_p")).withColumn(name, F.col("_row") + F.col("_ahead") + start)
    if group:
        first = out.groupBy(*group).agg(F.min(name).alias("_first")).withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)})
        same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
        on = same[0]
        for c in same[1:]:
            on = on & c
        out = out.join(first, on).withColumn(name, F.col(name) - F.col("_first") + start)
    return out.select(*df.columns, F.col(name).cast("long").alias(name))


#: Rows up to which a limit is taken by top-k in each task and one merge; beyond, rows are numbered and filtered.
TOP_ROWS = 10_000


def first_by_order(df: DataFrame, order: list[str | Column], n: int, most: int = TOP_ROWS) -> DataFrame:
    """The first ``n`` rows by ``order``. Ties at the end are broken as ``with_ordinal`` does, whichever way is taken."""
    if n <= most:
        plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        return df.orderBy(*order, F.xxhash64(*plain)).limit(n)
    return with_ordinal(df, order, "_place").where(F.col("_place") < n).drop("_place")


def zip_in_order(left: DataFrame, right: DataFrame, left_order: list[str | Column], right_order: list[str | Column], name: str = "pos", start: int = 0) -> DataFrame:
    """Rows side by side by their places; raises ``DataError`` if one side has more rows."""
    counts = left.count(), right.count()
    if counts[0] != counts[1]:
        raise DataError(f"{counts[0]} rows against {counts[1]}")
    return with_ordinal(left, left_order, name, start).join(with_ordinal(right, right_order, name, start), name)
