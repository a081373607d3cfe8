"""Arithmetic that a training launch must satisfy."""

from __future__ import annotations

from .checks import DataError


def launch_plan(processes: int, sequence_parallel: int, batch: int, micro: int, token_budget: int, max_length: int) -> dict[str, int]:
    """Data-parallel size, rows a rank and gradient steps; raises DataError where the numbers do not divide or fit."""
    if processes % sequence_parallel:
        raise DataError("processes do not divide by the sequence-parallel size")
    parallel = processes // sequence_parallel
    if batch % parallel:
        raise DataError("the batch does not divide by the data-parallel size")
    local = batch // parallel
    if local % micro:
        raise DataError("a rank's rows do not divide by the micro batch")
    if token_budget < max_length:
        raise DataError("the token budget is below the longest row")
    return {"data_parallel": parallel, "local_batch": local, "accumulation": local // micro}
