"""Before and after: transitions, deltas and bootstrap intervals."""

from __future__ import annotations

import math
import random
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinals import with_ordinal


def transitions(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how many turned right, wrong, or stayed."""
    a, b = F.col(before), F.col(after)
    return pairs.agg(
        F.count_if(~a & b).alias("wrong_to_right"), F.count_if(a & ~b).alias("right_to_wrong"),
        F.count_if(a & b).alias("both_correct"), F.count_if(~a & ~b).alias("both_wrong"),
    )


def turned(pairs: DataFrame, index: str, before: str, after: str) -> DataFrame:
    """``index, change`` of the rows that changed, a table rather than a list that grows in one place."""
    a, b = F.col(before), F.col(after)
    return pairs.where(a != b).select(index, F.when(b, "improved").otherwise("regressed").alias("change"))


def rates(pairs: DataFrame, before: str, after: str) -> DataFrame:
    a, b = (F.col(c).cast("int") for c in (before, after))
    return pairs.agg(F.avg(a).alias("before_rate"), F.avg(b).alias("after_rate"), F.avg(b - a).alias("delta"))


def _ends(samples: int) -> tuple[int, int]:
    return round((samples - 1) * 0.025), round((samples - 1) * 0.975)


#: Chances that a row is drawn at most 0, 1, 2, ... times in a resample: the Poisson distribution of mean 1.
DRAWN = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))


def bootstrap_by_hash(differences: DataFrame, index: str, value: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """``low, high`` of the mean difference by Poisson resampling; ``index`` tells rows apart.

    In resample b a row counts as often as a Poisson number of mean 1, which
    the hash md5(seed|b|index) picks. So a row's numbers need no other row, sums
    are pre-aggregated where the rows are, and one row a task and resample is
    shuffled. Null values are left out; no rows give one row of nulls.
    """
    rows = differences.where(F.col(value).isNotNull()).select(index, F.col(value).alias("_v"))
    draws = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    picked = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_b", F.col(index).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum((picked >= c).cast("int") for c in DRAWN)
    means = draws.select("_b", "_v", times.alias("_n")).groupBy("_b").agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))
    ranked = means.where("mean is not null").agg(F.array_sort(F.collect_list("mean")).alias("m"))  # one number a resample
    at = lambda share: F.get("m", F.greatest(F.lit(0), F.round((F.size("m") - 1) * share).cast("int")))
    return ranked.select(at(0.025).alias("low"), at(0.975).alias("high"))


#: Tasks that the resamples of ``bootstrap_exact`` are dealt out to, values in a piece and in a block of one, and words drawn at a time.
GROUPS, PIECE_VALUES, BLOCK_VALUES, WORDS = 64, 1 << 22, 1 << 16, 1 << 20


def _words(bits: np.random.MT19937, n: int) -> np.ndarray:
    """The next WORDS numbers that ``randrange(n)`` would look at; it passes over those from n up."""
    return np.random.Generator(bits).integers(0, 1 << 32, WORDS, dtype=np.uint32) >> np.uint32(32 - n.bit_length())


def _twister(key: bytes, at: int) -> np.random.MT19937:
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(key, "<u4"), "pos": at}}
    return bits


def _starts(n: int, firsts: list[int], seed: int):
    """``part, first, last, key, at``: the generator's state before the first resample of each part; only states are kept."""
    *key, at = random.Random(seed).getstate()[1]
    bits = _twister(np.array(key, "<u4").tobytes(), at)
    for part, (first, last) in enumerate(pairwise(firsts)):
        state = bits.state["state"]
        yield part, first, last, state["key"].astype("<u4").tobytes(), int(state["pos"])
        missing = (last - first) * n
        while missing:
            before = bits.state
            taken = _words(bits, n) < n
            found = int(np.count_nonzero(taken))
            if found >= missing:
                bits.state = before
                bits.random_raw(int(np.flatnonzero(taken)[missing - 1]) + 1, output=False)
                found = missing
            missing -= found


def _totals(values: np.ndarray, low: int, n: int, draws: int, bits: np.random.MT19937):
    """The sum of what each resample draws of the places from ``low`` that ``values`` holds."""
    whole = values.dtype.kind == "i" and int(np.abs(values).max()) * n < 1 << 62
    # a whole sum may be taken in any order and so a block of words at a time; others are taken in the order drawn
    total, kept, at, left = 0, [], 0, draws * n
    while left:
        places = _words(bits, n)
        places = places[places < n][:left]
        left -= len(places)
        done = 0
        while done < len(places):
            some = places[done : done + n - at].astype(np.int64) - low
            done, at = done + len(some), at + len(some)
            if low or len(values) < n:
                some = some[(some >= 0) & (some < len(values))]
            if whole:
                total += int(values[some].sum())
            else:
                kept += values[some].tolist()
            if at == n:
                yield total if whole else sum(kept)
                total, kept, at = 0, [], 0


def bootstrap_exact(differences: DataFrame, order: str, value: str, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """The same interval with the Mersenne Twister's draws in the order of ``random.Random(seed).randrange``.

    The draws are one sequence, but its state is small: one task runs it
    without any rows and notes the state before each part of the resamples,
    then the parts draw side by side, each from pieces of PIECE_VALUES values.
    Whole numbers are summed exactly; others in the order drawn inside a piece.
    No rows give no row; a null value is an error.
    """
    kind = "long" if differences.schema[value].dataType.typeName() in ("byte", "short", "integer", "long") else "double"
    rows = with_ordinal(differences.select(F.col(order).alias("_o"), F.col(value).cast(kind).alias("_v")), ["_o"], "_at")
    n = rows.count()
    spark = differences.sparkSession
    if not n:
        return spark.createDataFrame([], "low double, high double")
    if n >> 32:
        raise ValueError("randrange draws more than one word for so many rows")
    parts = min(GROUPS, samples)
    firsts = [samples * i // parts for i in range(parts + 1)]
    pieces = -(-n // PIECE_VALUES)

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        if table["_v"].null_count:
            raise ValueError("a difference is null")
        return pa.table({"piece": [key[0]], "block": [key[1]], "data": [table["_v"].to_numpy().tobytes()]}, pa.schema([("piece", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]))

    def states(batches):
        for _ in batches:
            pass
        columns = list(zip(*_starts(n, firsts, seed)))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "first", "last", "key", "at"])

    def draw(held: pa.Table, starts: pa.Table) -> pa.Table:
        s = starts.to_pylist()[0]
        values = np.frombuffer(b"".join(held.sort_by("block")["data"].to_pylist()), "<i8" if kind == "long" else "<f8")
        totals = list(_totals(values, s["piece"] * PIECE_VALUES, n, s["last"] - s["first"], _twister(s["key"], s["at"])))
        return pa.table({"sample": pa.array(range(s["first"], s["last"]), pa.int32()), "total": pa.array(totals, pa.int64() if kind == "long" else pa.float64())})

    blocks = rows.groupBy(F.expr(f"_at div {PIECE_VALUES}").alias("piece"), F.expr(f"_at div {BLOCK_VALUES}").alias("block")).applyInArrow(block, "piece long, block long, data binary")
    held = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part", "piece")
    starts = spark.range(0, 1, 1, 1).mapInArrow(states, "part int, first int, last int, key binary, at int")
    starts = starts.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long")))).repartition(parts, "part", "piece")
    totals = held.groupBy("part", "piece").cogroup(starts.groupBy("part", "piece")).applyInArrow(draw, f"sample int, total {kind}")
    means = totals.groupBy("sample").agg((F.sum("total") / n).alias("mean"))
    low, high = _ends(samples)
    ranked = means.agg(F.array_sort(F.collect_list("mean")).alias("m"))  # one number a resample
    return ranked.select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))
