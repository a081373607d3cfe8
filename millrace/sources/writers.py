"""Writers: Parquet read back, JSON lines, one file a row, reports. Spark's commit protocol stands for temporary names and renames."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import format_metric, format_percent
from ..operators.checks import DataError, gate
from .committed import write_files_committed


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> int:
    """Zstandard Parquet; the rows read back must be as many as were written. ``files`` is for small, single-file sets."""
    counted = df.count()
    (df.coalesce(files) if files else df).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path).count()
    if back != counted:
        raise DataError(f"wrote {counted} rows, read {back}")
    return back


def with_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls do not survive in these columns: the first row with one raises, as file schemas forget it."""
    gate(df.where(" or ".join(f"`{c}` is null" for c in columns)), "a required value is missing")
    return df


def write_json_report(report: dict | DataFrame, path: str) -> None:
    """A one-row report as indented JSON under its name at once, by a rename on the driver."""
    if isinstance(report, DataFrame):
        report = report.first().asDict(recursive=True)
    text = json.dumps(report, ensure_ascii=False, indent=2, allow_nan=False) + "\n"
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def json_lines(df: DataFrame) -> DataFrame:
    """``value``: compact JSON of each row, nulls kept; NaN raises."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    if numbers:
        gate(df.where(" or ".join(f"isnan(`{c}`)" for c in numbers)), "NaN is no JSON")
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("errorifexists").text(path)


def write_file_per_row(df: DataFrame, name: str, text: str, folder: str, suffix: str = ".card.genui.jsonl") -> int:
    """A file a row in a new folder that appears whole or not at all; how many they are."""
    return write_files_committed(df, name, text, folder, suffix)


def remove_stale(paths: list[str]) -> None:
    """Known leftovers go after a new write succeeded; links are refused."""
    for p in paths:
        if os.path.islink(p):
            raise DataError(f"{p} is a link")
        if os.path.exists(p):
            os.unlink(p)


def table_line(*cells: Column | str) -> Column:
    cols = [c if isinstance(c, Column) else F.lit(c) for c in cells]
    return F.concat(F.lit("| "), *[x for i, c in enumerate(cols) for x in ((F.lit(" | "), c) if i else (c,))], F.lit(" |"))


def markdown_report(report: DataFrame, failures: DataFrame, kind: str = "error_type") -> DataFrame:
    """``line, text``: a run report (see ``run_report``) for readers, in order."""
    unit = lambda c, u, whole=False: F.concat(format_metric(F.col(c), whole), F.lit(f" {u}"))
    rows = [
        ("Total samples", format_metric(F.col("total"), True)), ("Successful samples", format_metric(F.col("success"), True)),
        ("Failed samples", format_metric(F.col("failed"), True)), ("Success rate", format_percent(F.col("success_rate"))),
        *((f"Latency {k}", unit(f"latency_{k}", "ms")) for k in ("min", "p50", "p95", "max", "avg")),
        ("Request throughput", unit("requests_per_second", "req/s")), ("Successful request throughput", unit("successful_per_second", "req/s")),
        ("Completion token throughput", unit("tokens_per_second", "tok/s")),
        *((f"{n} tokens {k}", unit(f"{n.lower()}_{k}", "tokens")) for n in ("Prompt", "Completion") for k in ("min", "p50", "p95", "max")),
    ]
    lines = F.array(*(table_line(name, value) for name, value in rows))
    told = report.select(F.posexplode(lines).alias("line", "text"))
    more = failures.select((F.lit(1000) + F.row_number().over(_window(kind))).alias("line"), table_line(F.concat(F.lit("Failure: "), F.col(kind)), F.col("n").cast("string")).alias("text"))
    return told.unionByName(more).orderBy("line")


def _window(kind: str):
    from pyspark.sql import Window

    return Window.orderBy(kind)  # one row a kind of failure


def as_rows(df: DataFrame, most: int = 10_000) -> list[Row]:
    """A report's few rows on the driver; an error if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows
