import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.checks import DataError
from millrace.sources import committed


def test_all_files_appear_together(spark, tmp_path):
    df = spark.range(500).repartition(16).select(F.format_string("c%03d", "id").alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("é\n"), F.col("id").cast("string"))).alias("t"))
    assert committed.write_files_committed(df, "n", "t", str(tmp_path / "cards"), ".jsonl") == 500
    assert os.listdir(tmp_path) == ["cards"] and len(os.listdir(tmp_path / "cards")) == 500
    assert (tmp_path / "cards" / "c008.jsonl").read_text(encoding="utf-8") == "é\n8" and (tmp_path / "cards" / "c007.jsonl").read_bytes() == b""
    with pytest.raises(DataError, match="already"):
        committed.write_files_committed(df, "n", "t", str(tmp_path / "cards"))


def test_no_rows(spark, tmp_path):
    assert committed.write_files_committed(spark.createDataFrame([], "n string, t string"), "n", "t", str(tmp_path / "none")) == 0
    assert os.listdir(tmp_path) == ["none"]


@pytest.mark.parametrize("name", ["a/b", ".hidden", "_files.json", ""])
def test_a_failing_task_leaves_nothing(spark, tmp_path, name):
    df = spark.range(200).repartition(8).select(F.when(F.col("id") == 133, name).otherwise(F.col("id").cast("string")).alias("n"), F.lit("x").alias("t"))
    with pytest.raises(Exception, match="no file name"):
        committed.write_files_committed(df, "n", "t", str(tmp_path / "cards"))
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("name", ["7", None])
def test_names_twice_or_missing(spark, tmp_path, name):
    df = spark.range(50).select(F.when(F.col("id") == 3, name).otherwise(F.col("id").cast("string")).alias("n"), F.lit("x").alias("t"))
    with pytest.raises(DataError, match="twice"):
        committed.write_files_committed(df, "n", "t", str(tmp_path / "cards"))
    assert os.listdir(tmp_path) == []


class Row:
    def __init__(self, name, text):
        self.name, self.text = name, text


def test_an_attempt_that_is_run_again_adds_nothing(tmp_path):
    """Attempts as Spark makes them: some fail after part of their rows, some end but are not the committed ones."""
    rnd = random.Random(3)
    staging, target = str(tmp_path / ".staging"), str(tmp_path / "out")
    os.mkdir(staging)
    writer, messages = committed.CommittedWriter(target, ".x", staging), []
    for task in range(6):
        rows = [Row(f"{task}-{i}", "t" * i) for i in range(rnd.randint(0, 9))]
        writer.write(iter(rows))  # a speculative attempt whose message is not taken

        def broken(rows=rows):
            yield from rows[:2]
            raise RuntimeError("lost")

        with pytest.raises(RuntimeError):
            writer.write(broken())
        messages.append(writer.write(iter(rows)))
    writer.commit([*messages, None])
    assert len(os.listdir(target)) == sum(m.files for m in messages) and os.listdir(tmp_path) == ["out"]
    again = committed.CommittedWriter(str(tmp_path / "second"), "", staging)
    os.mkdir(staging)
    again.write(iter([Row("a", "b")]))
    again.abort([None])
    again.abort([None])
    with pytest.raises(OSError):
        again.write(iter([Row("a", "b")]))  # a task that outlives the abort
    assert os.listdir(tmp_path) == ["out"]
