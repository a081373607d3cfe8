"""Queries over readers and writers: each writes a file made from the tables to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_folder
from ..sources import readers, writers
from .registry import Tables, query


def _text_file(lines: DataFrame, name: str) -> str:
    """A folder with one text file."""
    path = f"{work_folder(lines.sparkSession)}/{name}"
    lines.coalesce(1).write.text(path)
    return path


#: Rows that one task sorts and writes as a part.
PART_ROWS = 500_000


def _in_order(df: DataFrame, key: str, value: Column) -> DataFrame:
    """The lines by the key, in as many parts as their number asks for, none sorted in one task as a whole."""
    parts = -(-df.count() // PART_ROWS) or 1
    return df.select(key, value.alias("value")).repartitionByRange(parts, key).sortWithinPartitions(key).select("value")


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, 'o' || o_orderkey AS id, '{"z":' || o_custkey || ',"a":"}{' || o_orderstatus || '\\\"]"}' AS body FROM orders""", python=True)
def source_task_records(t: Tables) -> DataFrame:
    """An array over many lines, with braces, quotes and brackets inside its strings, in parts that are each cut after a record."""
    record = F.format_string('{"id":"o%s",\n "taskSpec":{"z": %s, "a": "}{%s\\\"]"}', "o_orderkey", "o_custkey", "o_orderstatus")
    first = t.orders.agg(F.min("o_orderkey")).first()[0]
    lead = F.when(F.col("o_orderkey") == first, F.lit("[")).otherwise(F.lit("\n,"))
    top = work_folder(t.spark)
    parts = [f"{top}/0-records", f"{top}/1-end"]  # read in this order
    _in_order(t.orders, "o_orderkey", F.concat(lead, record)).write.option("lineSep", "}").text(parts[0])  # the last brace of each record ends its line
    t.spark.createDataFrame([("\n]",)], "value string").coalesce(1).write.text(parts[1])
    return readers.read_task_records(t.spark, parts, whole=True)


@query("SELECT 'p' || p_partkey AS id, p_name AS label FROM part", python=True)
def source_labels(t: Tables) -> DataFrame:
    line = F.to_json(F.struct(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("designCompactDsl")))
    blank = F.when(F.col("p_partkey") % 5 == 0, F.concat(line, F.lit("\n\n"))).otherwise(line)
    return readers.read_labels(t.spark, _text_file(t.part.select(blank), "labels.jsonl")).select("id", "label")


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderkey) * 2 - 1 AS BIGINT) AS line_number, 'order ' || o_orderkey AS value FROM orders""")
def source_numbered_lines(t: Tables) -> DataFrame:
    """A blank line after every other one, a text in parts of many byte ranges."""
    path = f"{work_folder(t.spark)}/orders.txt"
    _in_order(t.orders, "o_orderkey", F.concat(F.lit("order "), "o_orderkey", F.lit("\n"))).write.text(path)
    return readers.numbered_lines(t.spark, path, whole=True).where("value <> ''")


@query("SELECT 'Be brief about ' || r_name || '.' AS prompt FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)", python=True)
def source_prompt(t: Tables) -> DataFrame:
    text = t.region.orderBy("r_regionkey").limit(1).select(F.concat(F.lit("\n  Be brief about "), "r_name", F.lit(".  \n")))
    return t.spark.createDataFrame([(readers.read_prompt(t.spark, _text_file(text, "prompt.md")),)], "prompt string")


@query("SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS sha256 FROM region", python=True)
def source_file(t: Tables) -> DataFrame:
    data = readers.read_source(t.spark, _text_file(t.region.orderBy("r_name").select("r_name"), "names.txt"))
    return t.spark.createDataFrame([(bytearray(data),)], "data binary").select(F.sha2("data", 256).alias("sha256"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def source_parquet_columns(t: Tables) -> DataFrame:
    path = f"{work_folder(t.spark)}/customers"
    t.customer.write.parquet(path)
    return readers.read_parquet(t.spark, [path], ["c_custkey", "c_mktsegment"])


@query("SELECT CASE WHEN item_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, text AS question, item_id::VARCHAR AS answer FROM benchmark")
def source_splits(t: Tables) -> DataFrame:
    path = work_folder(t.spark)
    rows = t.benchmark.select(F.col("text").alias("question"), F.col("item_id").cast("string").alias("answer"))
    rows.where("answer % 4 <> 0").write.parquet(f"{path}/train")
    rows.where("answer % 4 = 0").write.parquet(f"{path}/test")
    return readers.read_splits(t.spark, path)


@query("SELECT 'p' || p_partkey AS id, '2x2' AS size, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'stop' END AS \"finishReason\", p_size::BIGINT AS \"completionTokens\", p_name AS \"designCompactDsl\" FROM part")
def source_generations(t: Tables) -> DataFrame:
    reason = F.when(F.col("p_partkey") % 3 != 0, F.lit("stop"))
    rows = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("2x2").alias("size"), reason.alias("finishReason"), F.col("p_size").cast("long").alias("completionTokens"), F.col("p_name").alias("designCompactDsl"))
    path = f"{work_folder(t.spark)}/generations.jsonl"
    writers.write_json_lines(rows, path)
    return readers.read_generations(t.spark, path).select("id", "size", "finishReason", "completionTokens", "designCompactDsl")


@query("SELECT doc_id AS index, quality = 1 AS correct, (SELECT count(*) FROM labels) AS total FROM labels")
def source_results(t: Tables) -> DataFrame:
    path = work_folder(t.spark)
    writers.write_json_lines(t.labels.select(F.col("doc_id").alias("index"), (F.col("quality") == 1).alias("correct")), f"{path}/run.jsonl")
    t.labels.agg(F.count(F.lit(1)).alias("total")).coalesce(1).write.json(f"{path}/run.summary.json")
    rows, summary = readers.read_results(t.spark, f"{path}/run.jsonl")
    return rows.crossJoin(F.broadcast(summary.select("total"))).select("index", "correct", "total")  # the summary is one row


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def source_limit(t: Tables) -> DataFrame:
    return readers.first_rows(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 50)


@query("SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS written FROM supplier")
def sink_parquet(t: Tables) -> DataFrame:
    path = f"{work_folder(t.spark)}/suppliers"
    n = writers.write_parquet(t.supplier.select("s_suppkey", "s_name"), path)
    return t.spark.read.parquet(path).withColumn("written", F.lit(n).cast("long"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def sink_json_lines(t: Tables) -> DataFrame:
    path = f"{work_folder(t.spark)}/orders.jsonl"
    writers.write_json_lines(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return t.spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string").json(path)
