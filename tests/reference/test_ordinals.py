"""Global ordinals against a sort in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import messages, ordinals
from millrace.operators.checks import DataError
from millrace.sources import readers

ROWS = [(i, random.Random(i).choice([None, 1, 1, 1, 2, 5]), f"t{i % 7}") for i in range(3000)]


def table(spark, rows=ROWS, parts=7):
    return spark.createDataFrame(rows, "id long, v int, t string").repartition(parts)


def by_value(r):
    return (r[1] is not None, r[1] or 0, r[0])


@pytest.mark.parametrize("partitions", [4, 400])
def test_places_equal_a_sort(spark, partitions):
    got = {r.id: r.pos for r in ordinals.with_ordinal(table(spark), ["v", "id"], partitions=partitions).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(ROWS, key=by_value))}


@pytest.mark.parametrize("partitions", [4, 400])
def test_places_in_groups(spark, partitions):
    rows = [*ROWS, (9000, 1, None), (9001, None, None)]
    got = {r.id: r.nth for r in ordinals.with_ordinal(table(spark, rows), ["v", "id"], "nth", 1, ["t"], partitions).collect()}
    want = {}
    for t in {r[2] for r in rows}:
        want |= {r[0]: n + 1 for n, r in enumerate(sorted((r for r in rows if r[2] == t), key=by_value))}
    assert got == want


def test_ties_spread_and_every_place_is_given_once(spark):
    df = table(spark, [(i, 1, "x") for i in range(5000)])
    placed = ordinals.with_ordinal(df, ["v"], partitions=20)
    assert sorted(r.pos for r in placed.collect()) == list(range(5000))
    again = {r.id: r.pos for r in ordinals.with_ordinal(df.repartition(3), ["v"], partitions=5).collect()}
    assert again == {r.id: r.pos for r in placed.collect()}
    parts = df.repartitionByRange(20, F.col("v"), F.xxhash64(*df.columns)).groupBy(F.spark_partition_id()).count()
    assert parts.count() > 10  # one value does not meet in one task
    alike = table(spark, [(1, 1, "x")] * 50)
    assert sorted(r.pos for r in ordinals.with_ordinal(alike, ["v"]).collect()) == list(range(50))


def test_directions_names_and_empty_tables(spark):
    df = table(spark).withColumn("POS", F.lit("mine"))
    got = {r.id: r.pos for r in ordinals.with_ordinal(df, [F.desc_nulls_last("v"), F.col("id")]).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(ROWS, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])))}
    assert ordinals.with_ordinal(table(spark, []), ["v"]).collect() == []


def test_no_window_over_all_rows(spark):
    plan = ordinals.with_ordinal(table(spark), ["v"])._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window" in line)
    assert "sum(n" in window  # over the counts of the partitions


@pytest.mark.parametrize("most", [5, 5000])
def test_limits(spark, most):
    got = sorted(r.id for r in ordinals.first_by_order(table(spark), ["v", "id"], 700, most).collect())
    assert got == sorted(r[0] for r in sorted(ROWS, key=by_value)[:700])
    ties = [sorted(r.id for r in ordinals.first_by_order(table(spark), ["v"], 700, m).collect()) for m in (5, 5000)]
    assert ties[0] == ties[1]


def test_numbers_and_zips(spark):
    small = table(spark, ROWS[:12], 3)
    assert sorted(r.id for r in messages.numbered_rows(small, ["id"]).collect()) == [f"taskspec-{i:03d}" for i in range(1, 13)]
    assert {r.id: r.pos for r in readers.place_in_file(small, "id").collect()} == {i: i for i in range(12)}
    other = small.select((-F.col("id")).alias("minus"))
    zipped = ordinals.zip_in_order(small.select("id"), other, ["id"], ["minus"]).collect()
    assert sorted((r.pos, r.id, r.minus) for r in zipped) == [(i, i, i - 11) for i in range(12)]
    with pytest.raises(DataError, match="12 rows against 11"):
        ordinals.zip_in_order(small, other.limit(11), ["id"], ["minus"])
