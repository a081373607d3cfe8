"""Exact order statistics of many groups at once, by narrowing ranges of values.

A pass cuts the range of values that holds a wanted rank into cells, counts the
cells where the rows are, and goes on in the one that holds the rank, between
the least and the greatest value seen there, until these are one value. What a
task holds is cells, not values; what a pass hands on is one row a group and
range. Ranks in one range share it, so a row falls into one range at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder

CELLS = 4096


def _written(df: DataFrame) -> DataFrame:
    out = work_folder(df.sparkSession)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _same(names: list[str], renamed: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(names, renamed):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _difference(a: str, b: str) -> Column:
    """As a double, from the exact difference where that fits the type."""
    x, y = F.col(a), F.col(b)
    return F.coalesce(F.try_subtract(x, y).cast("double"), x.cast("double") - y.cast("double"))


def select_ranks(df: DataFrame, value: str, ranks: dict[str, Column], group: list[str] = (), cells: int = CELLS) -> DataFrame:
    """``group..., name, value``: of each group the values at the 0-based ``ranks`` of its sorted values.

    A rank is a column over ``n``, the number of the group's values, and is
    brought into 0 to n - 1. Null and NaN are no values; groups without values
    give no rows. Integers, decimals and doubles are exact. Each pass reads the
    input once and narrows a range at least ``cells``-fold or to the values that
    lie in it; counts to some thousands take one or two.
    """
    group = list(group)
    held = df.select(*group, F.col(value).alias("v")).where(F.col("v").isNotNull())
    if dict(held.dtypes)["v"] in ("double", "float"):
        held = held.where(~F.isnan("v"))
    named = [f"_g{i}" for i in range(len(group))]
    first = held.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(rank.cast("long"), F.col("n") - 1)).cast("long").alias("rank")) for name, rank in ranks.items()))
    state = _written(first.select(*(F.col(g).alias(a) for g, a in zip(group, named)), "lo", "hi", wanted.alias("wanted")))
    done = []
    while True:
        done.append(state.where("lo = hi").select(*named, F.explode("wanted").alias("w"), F.col("lo").alias("value")))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        inside = held.join(open_.select(*named, "lo", "hi"), _same(group, named) & F.col("v").between(F.col("lo"), F.col("hi")))
        # the least value is in the first cell and the greatest in the last, also where a difference is infinite
        place = F.when(F.col("v") == F.col("lo"), 0.0).otherwise(F.least(_difference("v", "lo") / _difference("hi", "lo"), F.lit(1.0)))
        cell = F.least(F.floor(place * cells), F.lit(cells - 1))
        counts = inside.groupBy(*named, "lo", "hi", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        by = Window.partitionBy(*named, "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most ``cells`` rows
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
        old = [f"_o{i}" for i in range(len(named))]
        wants = open_.select(*(F.col(a).alias(b) for a, b in zip(named, old)), F.col("lo").alias("old_lo"), F.explode("wanted").alias("w"))
        on = _same(named, old) & (F.col("lo") == F.col("old_lo")) & (F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("n"))
        inner = F.struct(F.col("w.name").alias("name"), (F.col("w.rank") - F.col("before")).alias("rank"))
        state = counts.join(wants, on).select(*named, F.col("least").alias("lo"), F.col("most").alias("hi"), inner.alias("w"))
        state = _written(state.groupBy(*named, "lo", "hi").agg(F.collect_list("w").alias("wanted")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*(F.col(a).alias(g) for g, a in zip(group, named)), F.col("w.name").alias("name"), "value")


def nearest(q: float) -> Column:
    """The rank that ceil(n * q) has, from 0."""
    return F.ceil(F.col("n") * F.lit(q)) - 1


def rounded(q: float) -> Column:
    """The rank (n - 1) * q, halves to even."""
    return F.bround((F.col("n") - 1) * F.lit(q), 0)


def middle() -> dict[str, Column]:
    """The ranks of the two middle values, one for odd n."""
    return {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}


def ranks_beside(df: DataFrame, base: DataFrame, value: str, ranks: dict[str, Column], group: list[str] = (), kind: str | None = None) -> DataFrame:
    """``base``, one row a group, with a column for each rank's value."""
    group = list(group)
    chosen = select_ranks(df, value, ranks, group)
    held = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks]
    wide = chosen.groupBy(*group).agg(*held).withColumnsRenamed({g: f"_r{i}" for i, g in enumerate(group)})
    out = base.join(wide, _same(group, [f"_r{i}" for i in range(len(group))]), "left") if group else base.crossJoin(wide)  # one row against one row
    return out.select(*base.columns, *(F.col(n).cast(kind) if kind else F.col(n) for n in ranks))
