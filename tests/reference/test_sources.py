import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.checks import DataError
from millrace.plans import datasets
from millrace.session import ship_package
from millrace.sources import readers, writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_training_set(spark, tmp_path):
    ship_package(spark)
    n = 70
    tasks = write(tmp_path / "t.json", "﻿" + json.dumps([{"id": f"c{i}", "taskSpec": {"b": 1.0, "a": i}} for i in range(n)]))
    labels = write(tmp_path / "l.jsonl", "\n\n".join(json.dumps({"id": f"c{i}", "designCompactDsl": f"  card {i} "}) for i in reversed(range(n))))
    prompt = write(tmp_path / "p.md", "﻿ be brief \n")
    for exact in (False, True):
        out = str(tmp_path / f"out{exact}")
        assert datasets.build_training_set(spark, tasks, labels, prompt, out, 0.05, exact_shuffle=exact) == {"train": 38, "validation": 32}
        rows = {r.id: r for s in ("train", "validation") for r in spark.read.parquet(f"{out}/{s}").collect()}
        assert len(rows) == n and not rows["c3"].enable_thinking
        assert [tuple(m) for m in rows["c3"].messages] == [("system", "be brief"), ("user", '{"b":1.0,"a":3}'), ("assistant", "card 3")]


@pytest.mark.parametrize("text", ["{}", "[1]", '[{"id":" a","taskSpec":{}}]', '[{"id":"a","taskSpec":{"x":NaN}}]', '[{"id":"a","taskSpec":{}},{"id":"a","taskSpec":{}}]', "[", '[{"id":"a","taskSpec":[]}]'])
def test_bad_tasks(spark, tmp_path, text):
    ship_package(spark)
    with pytest.raises(DataError):
        readers.read_task_records(spark, write(tmp_path / "t.json", text))


@pytest.mark.parametrize("label", ["<THINK>x", "```x", " ", "x```"])
def test_bad_labels(spark, tmp_path, label):
    with pytest.raises(DataError):
        readers.read_labels(spark, write(tmp_path / "l.jsonl", json.dumps({"id": "a", "designCompactDsl": label})))


def test_generations(spark, tmp_path):
    good = {"id": "a", "size": "2x2", "finishReason": None, "completionTokens": 3, "designCompactDsl": ""}
    assert readers.read_generations(spark, write(tmp_path / "g.jsonl", json.dumps(good))).first().completionTokens == 3
    for bad in ({**good, "completionTokens": True}, {**good, "completionTokens": -1}, {**good, "completionTokens": "3"}, {k: v for k, v in good.items() if k != "size"}):
        with pytest.raises(DataError):
            readers.read_generations(spark, write(tmp_path / "b.jsonl", json.dumps(bad)))
    with pytest.raises(DataError):
        readers.read_generations(spark, write(tmp_path / "d.jsonl", json.dumps(good) + "\n" + json.dumps(good)))


def test_results_and_comparison(spark, tmp_path):
    ship_package(spark)
    runs = []
    for name, flags in (("before", [True, False, True]), ("after", [True, True, False])):
        path = write(tmp_path / f"{name}.jsonl", "\n".join(json.dumps({"index": i, "question": "q", "reference": "1", "correct": f}) for i, f in enumerate(flags)))
        write(tmp_path / f"{name}.summary.json", json.dumps({"seed": 1, "model_path": name}))
        runs.append(readers.read_results(spark, path))
    got = datasets.compare_runs(*runs, samples=50, settings=["seed"])
    assert tuple(got["transitions"].first()) == (1, 1, 1, 0)
    with pytest.raises(DataError, match="model_path"):
        datasets.compare_runs(*runs, samples=50, settings=["model_path"])


def test_writers(spark, tmp_path):
    ship_package(spark)
    df = spark.createDataFrame([("a", None, 1.5), ("b", "é", 2.0)], "name string, text string, x double").coalesce(1)
    writers.write_json_lines(df, str(tmp_path / "j"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert lines == ['{"name":"a","text":null,"x":1.5}', '{"name":"b","text":"é","x":2.0}']
    with pytest.raises(DataError):
        writers.json_lines(df.withColumn("x", F.lit(float("nan"))))
    writers.write_file_per_row(df.fillna("z"), "name", "text", str(tmp_path / "cards"))
    assert sorted(os.listdir(tmp_path / "cards")) == ["a.card.genui.jsonl", "b.card.genui.jsonl"]
    with pytest.raises(DataError):
        writers.write_file_per_row(df, "name", "text", str(tmp_path / "cards"))
    writers.write_json_report({"é": 1}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text(encoding="utf-8") == '{\n  "é": 1\n}\n'
    os.symlink(tmp_path / "r.json", tmp_path / "link")
    with pytest.raises(DataError):
        writers.remove_stale([str(tmp_path / "link")])


def test_report_lines(spark):
    from millrace.operators import stats

    rows = [(True, 100.0, 1, 20, None), (True, 150.0, 2, 64, None)]
    df = spark.createDataFrame(rows, "ok boolean, latency_ms double, prompt_tokens int, completion_tokens int, error_type string")
    df = df.withColumn("ok", F.col("latency_ms") < 120)
    report = writers.markdown_report(stats.run_report(df, 4000.0), stats.failure_counts(df.withColumn("error_type", F.lit("empty"))))
    lines = [r.text for r in report.collect()]
    for want in ("| Success rate | 50.00% |", "| Request throughput | 0.50 req/s |", "| Completion token throughput | 21.00 tok/s |", "| Latency p50 | 100.00 ms |", "| Latency p95 | 150.00 ms |", "| Failure: empty | 1 |"):
        assert want in lines


def test_small_readers(spark, tmp_path):
    path = write(tmp_path / "b.txt", "﻿x\ny")
    assert readers.starts_with_bom(spark, path).first().bom
    assert readers.numbered_lines(spark, path).count() == 2
    assert readers.read_source(spark, path=path).endswith(b"y")
    with pytest.raises(DataError):
        readers.read_source(spark)
    assert readers.first_rows(spark.range(9), "id", 2).count() == 2 and readers.first_rows(spark.range(9), "id", -1).count() == 9
    with pytest.raises(DataError):
        readers.first_rows(spark.range(9), "id", 0)


def test_token_analysis(spark):
    df = spark.createDataFrame([("train", f"r{i}", i, 1, i + 1) for i in range(1, 21)], "split string, id string, prompt_tokens long, assistant_tokens long, total_tokens long")
    got = datasets.analyse_tokens(df, context_length=20, alignment=16)
    assert got["splits"].first().total_tokens_p95 == 20 and tuple(got["length"].first()) == (21, 32)
    assert got["longest"].count() == 10 and [r.id for r in got["violations"].collect()] == ["r20"]


def test_test_set(spark):
    rec = lambda s: json.dumps({"userQuery": "q", "size": s, "dataModelSchema": {}, "eventCandidates": [], "assetCandidates": []})
    df = spark.createDataFrame([(0, rec("2x4")), (1, rec("2x2")), (2, rec("2x2"))], "pos int, record string")
    got = datasets.build_test_set(spark, df, "sys").collect()
    assert [r.id for r in got] == ["taskspec-001", "taskspec-002"] and [m.role for m in got[0].messages] == ["system", "user"]
    with pytest.raises(DataError):
        datasets.build_test_set(spark, df.withColumn("record", F.lit("{}")), None)


def test_ordered_texts_are_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    from millrace.plans import file_queries

    monkeypatch.setattr(file_queries, "PART_ROWS", 30)
    spark.createDataFrame([(i * 3 % 101, i, "OPF"[i % 3]) for i in range(101)], "o_orderkey long, o_custkey long, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    t = file_queries.Tables(spark, str(tmp_path))
    lines = file_queries._in_order(t.orders, "o_orderkey", F.col("o_orderkey").cast("string"))
    assert max(lines.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 60
    got = file_queries.source_numbered_lines(t).orderBy("line_number").collect()
    assert [tuple(r) for r in got] == [(2 * i + 1, f"order {i}") for i in range(101)]
    by_key = {i * 3 % 101: (i, "OPF"[i % 3]) for i in range(101)}
    got = file_queries.source_task_records(t).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(k, f"o{k}", '{"z":%d,"a":"}{%s\\"]"}' % by_key[k]) for k in range(101)]
