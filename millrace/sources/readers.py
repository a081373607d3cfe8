"""Readers: JSON and JSON-lines records, Parquet with required columns, prompts, runs, pages of a URL."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_fence, has_think_tag, is_valid_id, strip
from ..operators.checks import DataError, duplicates_in_order, gate, required_columns
from ..operators.ordinals import first_by_order, with_ordinal
from .records import array_elements, element_of, numbered_text, written_once


def record_of(pos: int, text: str, last: bool, field: str) -> tuple[str | None, str | None, str | None]:
    """(id, canonical body, problem) of an array's element."""
    own, problem = element_of(pos, text, last)
    if problem or last:
        return None, None, problem
    try:
        r = json.loads(own)
    except ValueError as e:
        return None, None, f"no JSON: {e}"
    inner, id_ = r.get(field), r.get("id")
    id_ = id_ if isinstance(id_, str) else None
    if not isinstance(inner, dict):
        return id_, None, f"{field} is no object"
    try:
        return id_, json.dumps(inner, ensure_ascii=False, separators=(",", ":"), allow_nan=False), None
    except ValueError:
        return id_, None, "a number is not finite"


def read_task_records(spark: SparkSession, path: str | list[str], field: str = "taskSpec", whole: bool = False) -> DataFrame:
    """``pos, id, body``: the records of a JSON array file, bodies in canonical text with their key order; the first bad one raises.

    The file is read by many tasks (``records.array_elements``); an array that does not close raises too.
    With ``whole`` the files are the parts of one array.
    """

    def run(batches):
        for b in batches:
            told = [record_of(*row, field) for row in zip(*(b.column(i).to_pylist() for i in range(3)))]
            columns = list(zip(*told)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.string()) for c in columns)], ["pos", "last", "id", "body", "problem"])

    elements = array_elements(spark, path, whole).select("pos", "text", "last")
    rows = written_once(elements.mapInArrow(run, "pos long, last boolean, id string, body string, problem string"))
    if not rows.where("last").limit(1).count():
        raise DataError("bad record: the array does not end")
    gate(rows.where("problem is not null"), "bad record", ["pos"])
    rows = rows.where("not last").drop("last", "problem")
    gate(rows.where(~is_valid_id(F.col("id"))), "bad id", ["pos"])
    gate(duplicates_in_order(rows, "id", "pos"), "repeated id", ["pos"])
    return rows


def read_labels(spark: SparkSession, path: str, field: str = "designCompactDsl") -> DataFrame:
    """``pos, id, label`` of a JSON-lines file: stripped labels without reasoning tags or fences; blank lines are skipped.

    ``pos`` is the line's place in the file from 0, blank lines counted; the file is read by many tasks.
    """
    lines = numbered_text(spark, path).where(F.length(strip(F.col("value"))) > 0)
    read = lines.withColumn("r", F.from_json("value", f"id string, {field} string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    rows = read.select((F.col("line_number") - 1).alias("pos"), "r.id", strip(F.col(f"r.{field}")).alias("label"), "r._bad")
    gate(rows.where("_bad is not null or label is null"), "bad line", ["pos"])
    gate(rows.where(~is_valid_id(F.col("id"))), "bad id", ["pos"])
    gate(duplicates_in_order(rows, "id", "pos"), "repeated id", ["pos"])
    gate(rows.where((F.length("label") == 0) | has_think_tag(F.col("label")) | has_fence(F.col("label"))), "bad label", ["pos"])
    return rows.drop("_bad")


def read_prompt(spark: SparkSession, path: str) -> str:
    """A whole file as stripped text; empty means no system message."""
    return spark.read.text(path, wholetext=True).first()[0].lstrip("﻿").strip()


def read_source(spark: SparkSession, path: str | None = None, url: str | None = None, timeout: int = 30) -> bytes:
    """The bytes of a file, by Spark's reader, or of a URL; exactly one is given."""
    if (path is None) == (url is None):
        raise DataError("give a file or a URL")
    if path is not None:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "millrace"}), timeout=timeout) as reply:
        return reply.read()


def read_parquet(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Files one after the other, with the columns that are needed; only those are scanned."""
    return required_columns(spark.read.parquet(*paths), columns).select(*columns)


def read_splits(spark: SparkSession, path: str, splits=("train", "test"), columns=("question", "answer")) -> DataFrame:
    """``split, question, answer`` of the named splits below a folder; each must be there and have rows."""
    out = None
    for s in splits:
        one = required_columns(spark.read.parquet(f"{path}/{s}"), list(columns)).select(F.lit(s).alias("split"), *columns)
        if one.isEmpty():
            raise DataError(f"{s} has no rows")
        out = one if out is None else out.unionByName(one)
    return out


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """Saved generations: id, size, finishReason, completionTokens, designCompactDsl; types, ids and counts are checked."""
    raw = numbered_text(spark, path).where(F.length(strip(F.col("value"))) > 0)
    fields = "id string, size string, finishReason string, completionTokens string, designCompactDsl string"
    kinds = F.try_parse_json("value")
    rows = raw.select(
        "line_number", F.from_json("value", fields).alias("r"), F.schema_of_variant(F.try_variant_get(kinds, "$.completionTokens", "variant")).alias("kind")
    ).select("line_number", "r.*", "kind")
    gate(rows.where("id is null or size is null or designCompactDsl is null"), "a field is missing", ["line_number"])
    gate(rows.where("kind is null or kind not in ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') or cast(completionTokens as bigint) < 0"), "completionTokens is a count", ["line_number"])
    gate(duplicates_in_order(rows, "id", "line_number"), "repeated id", ["line_number"])
    if rows.isEmpty():
        raise DataError("no generations")
    return rows.withColumn("completionTokens", F.col("completionTokens").cast("bigint")).drop("kind", "line_number")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation rows, one an index, and the one-row summary beside them (<stem>.summary.json)."""
    rows = spark.read.json(path)
    gate(rows.groupBy("index").count().where("count > 1"), "repeated index", ["index"])
    return rows, spark.read.option("multiLine", True).json(path.rsplit(".", 1)[0] + ".summary.json")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in file order, which a column tells; -1 is all."""
    if n == -1:
        return df
    if n < 1:
        raise DataError("a limit is positive")
    return first_by_order(df, [order], n)


def numbered_lines(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """``line_number, value`` of a file, blank lines too; with ``whole`` of a text in parts."""
    return numbered_text(spark, path, whole).drop("path")


def starts_with_bom(spark: SparkSession, path: str) -> DataFrame:
    """``path, bom`` by the bytes; text readers drop the mark."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom"))


def place_in_file(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the place by ``order`` from 0."""
    return with_ordinal(df, list(order))
