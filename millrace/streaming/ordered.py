"""Best-so-far over a stream in the order of event time, whatever the order of arrival."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class OrderedBest(StatefulProcessor):
    """Per run, the steps that wait for the watermark and the best of those it has passed.

    A step waits in a list until a timer at its own time fires; steps so
    released are taken by time, then by number, then by loss. What arrives at
    or behind the watermark is too late to be put in order and is told at once.
    """

    def __init__(self, min_delta: float):
        self.min_delta = min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "loss double")
        self.waiting = handle.getListState("waiting", "at long, step long, loss double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs()
        early, late = [], []
        for part in rows:
            for at, step, loss in zip(part["at"], part["step"], part["loss"]):
                loss = math.nan if loss is None else float(loss)
                (early if at > passed else late).append((int(at), int(step), loss))
        if early:
            self.waiting.appendList(early)
            for at in {e[0] for e in early}:
                self.handle.registerTimer(at)
        yield pd.DataFrame([(key[0], step, loss, "late") for _, step, loss in late], columns=["run", "step", "loss", "kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(w for w in waiting if w[0] <= passed and math.isfinite(w[2]))
        rest = [w for w in waiting if w[0] > passed]
        if len(rest) < len(waiting):  # the first of a run's timers releases for all that are due
            self.waiting.put(rest) if rest else self.waiting.clear()
        best = self.best.get()[0] if self.best.exists() else math.inf
        out = []
        for _, step, loss in due:
            if loss < best - self.min_delta:
                best = loss
                out.append((key[0], step, loss, "kept"))
        if out:
            self.best.update((best,))
        yield pd.DataFrame(out, columns=["run", "step", "loss", "kind"])

    def close(self) -> None:
        pass


def accepted_in_order(stream: DataFrame, time: str, late: str, min_delta: float = 0.0) -> DataFrame:
    """``run, step, loss, kind`` of a stream ``(run, step, loss, <time>)``.

    ``kept``: the step beat the best of its run by more than ``min_delta`` when
    steps are taken in the order of ``time``; it is told once the watermark,
    ``late`` behind the newest time seen, has passed it. ``late``: the step came
    behind the watermark and took no part. A loss that is null or not finite is
    never kept; rows without run, step or time are left out. State holds one
    number a run and what lies within ``late`` of the newest time. Needs the
    RocksDB state store provider.
    """
    marked = stream.withWatermark(time, late).where(F.col("run").isNotNull() & F.col("step").isNotNull() & F.col(time).isNotNull())
    # the processor gets the time as a number, so that Spark leaves late rows to it
    rows = marked.select(F.col("run").cast("string").alias("run"), F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"))
    return rows.groupBy("run").transformWithStateInPandas(
        statefulProcessor=OrderedBest(min_delta), outputStructType="run string, step long, loss double, kind string", outputMode="Append", timeMode="EventTime"
    )
