"""Best-so-far over runs of any length.

A step is accepted if its loss is below the best by more than the least gain,
and only then the best moves. What a chunk of a run makes of the best that
comes in is a step function: an accepted step is a new strict minimum of its
run, so the function needs only the chunk's minima and where the chain from
each of them ends. Chunks give their functions side by side, one fold over a
run's chunks finds what comes into each, and chunks then tell their steps side
by side again. No run is gathered: a task holds CHUNK rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import DataError
from .ordinals import with_ordinal, written

#: Rows of a chunk. A run of ten million steps has some hundred and fifty.
CHUNK = 65_536


def next_accepted(minima: np.ndarray, min_delta: float) -> np.ndarray:
    """Of falling ``minima``, the place of the first below each by more than ``min_delta``; their number where none is."""
    return np.searchsorted(-minima, -(minima - min_delta), side="right")


def step_function(minima: np.ndarray, before: float, min_delta: float) -> tuple[np.ndarray, np.ndarray]:
    """``tops, ends``: the best that leaves a chunk is the end beside the first top below (incoming best - ``min_delta``), or what came in.

    ``before`` is the least loss ahead of the chunk. The incoming best is at
    most ``min_delta`` above it, so minima further down are never entered first.
    """
    least = before - min_delta if np.isfinite(before) else np.inf
    ahead = next_accepted(minima, min_delta)
    ends = np.where(ahead < minima.size, ahead, np.arange(minima.size))
    while (further := ends[ends]).tolist() != ends.tolist():
        ends = further
    ends = minima[ends]
    used = min(np.searchsorted(-minima, -least, side="right") + 1, minima.size)
    tops, ends = minima[:used], ends[:used]
    last = np.r_[ends[1:] != ends[:-1], True]  # of neighbours with one end the lowest stands for all
    return tops[last], ends[last]


def apply_function(tops: np.ndarray, ends: np.ndarray, best: float, min_delta: float) -> float:
    at = np.searchsorted(-tops, -(best - min_delta), side="right")
    return float(ends[at]) if at < tops.size else best


def _chunk_functions(min_delta: float):
    """Over ``run, chunk, loss, before``, sorted by place: a function for each part of a run in a chunk."""

    def told(rows):
        run, chunk, loss, before = (np.concatenate(c) for c in zip(*rows))
        cuts = np.r_[np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (chunk[1:] != chunk[:-1])]), run.size]
        made = [step_function(loss[a:b], before[a], min_delta) for a, b in zip(cuts[:-1], cuts[1:])]
        lists = [pa.array([m[i] for m in made], pa.list_(pa.float64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(run[cuts[:-1]]), pa.array(chunk[cuts[:-1]]), *lists], ["_run", "_chunk", "tops", "ends"])

    def go(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            first = int(np.searchsorted(rows[1], rows[1][-1]))  # the last chunk may go on in the next batch
            if first:
                yield told([*held, [c[:first] for c in rows]])
                held = []
            elif held and held[-1][1][-1] != rows[1][0]:
                yield told(held)
                held = []
            held.append([c[first:] for c in rows])
        if held:
            yield told(held)

    return go


def _fold(min_delta: float):
    """Over a run's functions in order: the best that comes into each chunk. One function is held at a time."""

    def go(batches):
        run, best = None, np.inf
        for b in batches:
            into = []
            for own, tops, ends in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if own != run:
                    run, best = own, np.inf
                into.append(best)
                best = apply_function(tops.values.to_numpy(), ends.values.to_numpy(), best, min_delta)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(into, pa.float64())], ["_in_run", "_in_chunk", "_in"])

    return go


def _chain(min_delta: float):
    """Over minima sorted by place with the best that comes in: those that are accepted."""

    def go(batches):
        place, best = None, np.inf
        for b in batches:
            run, chunk, loss, into = (b.column(n).to_numpy(zero_copy_only=False) for n in ("_run", "_chunk", "_loss", "_in"))
            cuts = np.r_[np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (chunk[1:] != chunk[:-1])]), run.size] if run.size else []
            hits = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                if (run[a], chunk[a]) != place:
                    place, best = (run[a], chunk[a]), into[a]
                falling = -loss[a:z]
                while (at := int(np.searchsorted(falling, -(best - min_delta), side="right"))) < falling.size:
                    hits.append(a + at)
                    best = loss[a + at]
            yield b.take(pa.array(hits, pa.int64()))

    return go


def accepted_steps(df: DataFrame, group: list[str], step: str, loss: str, min_delta: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """The group, ``step`` and ``loss`` (a double) of each step at which a finite loss was below its run's best by more than ``min_delta``.

    Steps run by ``step``, those of one number by loss. Null, NaN and infinite
    losses are no steps; null groups are groups; rows alike are one after the
    other, so only the first can be accepted. No rows give no rows.
    """
    if not 0 <= min_delta < float("inf"):
        raise DataError("the least gain is a finite number, not below 0")
    own = F.col(loss).cast("double")
    finite = df.select(*group, F.col(step), own.alias("_loss")).where("_loss is not null and not isnan(_loss) and abs(_loss) < double('infinity')")
    placed = with_ordinal(finite, [*map(F.col, group), F.col(step), F.col("_loss")], "_pos").withColumn("_chunk", F.expr(f"_pos div {int(chunk)}"))
    here = Window.partitionBy(*group, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    falls = written(placed.withColumn("_least", F.min("_loss").over(here)).where("_least is null or _loss < _least").drop("_least"))  # a chunk's own minima
    parts = falls.groupBy(*group, "_chunk").agg(F.min("_loss").alias("_end"), F.min("_pos").alias("_first"))
    whole, ahead = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    told = parts.select(
        F.col("_chunk").alias("_c"), F.col("_first").alias("_f"), F.min("_first").over(whole).alias("_run"), F.count(F.lit(1)).over(whole).alias("_chunks"),
        F.coalesce(F.min("_end").over(ahead), F.lit(float("inf"))).alias("_before"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
    )
    on = F.col("_chunk") == F.col("_c")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    kept = falls.join(told, on).where("_loss < _before").select(*group, step, "_loss", "_pos", "_chunk", "_run", "_before", "_chunks")
    out = [*group, F.col(step), F.col("_loss").alias(loss)]
    if not min_delta:
        return kept.select(*out)
    kept = written(kept)
    several = kept.where("_chunks > 1").select("_run", "_chunk", "_loss", "_before", "_pos")
    functions = several.repartition("_chunk").sortWithinPartitions("_chunk", "_pos").mapInArrow(_chunk_functions(min_delta), "_run long, _chunk long, tops array<double>, ends array<double>")
    come = functions.repartition("_run").sortWithinPartitions("_run", "_chunk").mapInArrow(_fold(min_delta), "_in_run long, _in_chunk long, _in double")
    entered = kept.join(come, (F.col("_run") == F.col("_in_run")) & (F.col("_chunk") == F.col("_in_chunk")), "left")
    entered = entered.select(*group, step, "_loss", "_pos", "_chunk", "_run", F.coalesce("_in", F.lit(float("inf"))).alias("_in"))
    chained = entered.repartition("_chunk").sortWithinPartitions("_chunk", "_pos").mapInArrow(_chain(min_delta), entered.schema)
    return chained.select(*out)


def best_so_far(df: DataFrame, group: list[str], step: str, loss: str, min_delta: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """One row a group with a finite loss: ``best_loss``, ``accepted_steps`` in order and ``n_accepted``, as ``accepted_steps`` tells them.

    The list holds accepted steps only; where it is not selected, nothing is listed.
    """
    told = accepted_steps(df, group, step, loss, min_delta, chunk).withColumnRenamed(loss, "_loss").withColumnRenamed(step, "_step")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_step", F.negative("_loss").alias("_gain")))), lambda s: s["_step"].cast("bigint"))
    return told.groupBy(*group).agg(F.min("_loss").alias("best_loss"), steps.alias("accepted_steps"), F.count(F.lit(1)).cast("int").alias("n_accepted"))


def improvements(df: DataFrame, group: list[str], step: str, loss: str) -> DataFrame:
    """The rows that set a new minimum (no minimum gain): a running minimum over earlier rows."""
    w = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    before = F.min(loss).over(w)
    return df.where(F.col(loss).isNotNull() & ~F.isnan(F.col(loss).cast("double"))).withColumn("_before", before).where(F.col("_before").isNull() | (F.col(loss) < F.col("_before"))).drop("_before")
