import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import best
from millrace.operators.checks import DataError
from millrace.session import ship_package


def brute(rows, delta):
    """Accepted (run, step, loss) of (run, step, loss) rows, one step after the other."""
    out, least = [], {}
    for run, step, loss in sorted((r for r in rows if r[2] is not None and math.isfinite(r[2])), key=lambda r: (str(r[0]), r[1], r[2])):
        if loss < least.get(run, math.inf) - delta:
            least[run] = loss
            out.append((run, step, loss))
    return sorted(out, key=str)


def losses(n, seed):
    """A hot run that falls slowly and noisily, small runs, a null run, ties, and losses that are none."""
    rnd = random.Random(seed)
    rows = [("hot", i, 50 - i * 40 / n + rnd.gauss(0, 1.5)) for i in range(n)]
    rows += [(f"r{rnd.randrange(30)}", rnd.randrange(50), round(rnd.gauss(0, 2), 1)) for _ in range(n // 2)]
    rows += [(None, i, rnd.choice([3.0, -1.0, 2.5, None, math.nan, -math.inf, math.inf])) for i in range(40)]
    rows += [("down", i, -0.1 * i) for i in range(n // 3)] + [("none", 1, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("delta", [0.0, 0.35, 2.5, 100.0])
@pytest.mark.parametrize("chunk", [7, best.CHUNK])
def test_accepted_steps_against_one_loop(spark, delta, chunk):
    ship_package(spark)
    rows = losses(600, 4)
    df = spark.createDataFrame(rows, "run string, step long, loss double")
    got = best.accepted_steps(df, ["run"], "step", "loss", delta, chunk)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, delta)


def test_one_long_run_in_many_chunks(spark):
    ship_package(spark)
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("a"), F.lit("x").alias("b"), F.col("id").alias("step"), (1000 - F.sqrt("id") + F.pmod(F.col("id") * 7919, F.lit(1013)) / 100).alias("loss"))
    rows = [("x", r.step, r.loss) for r in df.collect()]
    for delta in (0.25, 3.0):
        got = best.accepted_steps(df, ["a", "b"], "step", "loss", delta, chunk=4096)
        assert [(r.b, r.step, r.loss) for r in got.orderBy("step").collect()] == sorted(brute(rows, delta), key=lambda r: r[1])
        one = best.best_so_far(df, ["a", "b"], "step", "loss", delta, chunk=4096).first()
        want = [r[1] for r in sorted(brute(rows, delta), key=lambda r: r[1])]
        assert one.accepted_steps == want and one.n_accepted == len(want)


def test_no_rows_and_a_bad_gain(spark):
    df = spark.createDataFrame([], "run string, step long, loss double")
    assert best.best_so_far(df, ["run"], "step", "loss", 0.5).collect() == []
    for bad in (-1.0, math.inf, math.nan):
        with pytest.raises(DataError):
            best.accepted_steps(df, ["run"], "step", "loss", bad)
