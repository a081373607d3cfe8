"""Best-so-far over a stream of losses, and tumbling statistics over events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType


class BestLoss(StatefulProcessor):
    """Per run the best loss; gives the rows that beat it by more than the least gain. The best moves only then."""

    def __init__(self, min_delta: float):
        self.min_delta = min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", StructType([StructField("loss", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        best = self.best.get()[0] if self.best.exists() else math.inf
        out = []
        for part in rows:
            for step, loss in sorted(zip(part["step"], part["loss"])):
                if loss is not None and math.isfinite(loss) and loss < best - self.min_delta:
                    best = float(loss)
                    out.append((key[0], int(step), best))
        if out:
            self.best.update((best,))
        yield pd.DataFrame(out, columns=["run", "step", "loss"])

    def close(self) -> None:
        pass


def accepted_steps(stream: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """``run, step, loss`` of a stream with those columns: the steps that a checkpoint is kept for.

    Needs the RocksDB state store provider.
    """
    return stream.groupBy("run").transformWithStateInPandas(
        statefulProcessor=BestLoss(min_delta), outputStructType="run string, step long, loss double", outputMode="Append", timeMode="None"
    )


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
