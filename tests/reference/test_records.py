"""Readers over many byte ranges against the whole text in plain Python."""

import json
import random

import pytest

from millrace.operators.checks import DataError
from millrace.session import ship_package
from millrace.sources import readers, records


@pytest.fixture(params=[200, 1 << 20])
def ranges(spark, request):
    """Byte ranges of so many bytes."""
    ship_package(spark)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, (str(request.param), "0", "1")):
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def write(path, text, newline="\n"):
    path.write_bytes(text.replace("\n", newline).encode())
    return str(path)


def test_lines_keep_their_numbers(spark, tmp_path, ranges):
    newline = "\r\n" if ranges == 200 else "\n"
    rnd = random.Random(1)
    lines = ["first", *("" if rnd.random() < 0.3 else "ü" * rnd.randint(1, 60) for _ in range(150)), "end"]
    path = write(tmp_path / "t.txt", "﻿" + "\n".join(lines), newline)
    df = records.numbered_text(spark, path)
    assert sorted((r.line_number, r.value) for r in df.collect()) == list(enumerate(lines, 1))
    if ranges == 200:
        assert spark.read.text(path).rdd.getNumPartitions() > 10


def test_several_files_are_numbered_each(spark, tmp_path, ranges):
    (tmp_path / "d").mkdir()
    for name, n in (("a", 30), ("b", 50)):
        write(tmp_path / "d" / name, "".join(f"{name}{i}\n" for i in range(n)))
    got = sorted((r.line_number, r.value) for r in records.numbered_text(spark, str(tmp_path / "d")).collect())
    assert got == sorted((i + 1, f"{name}{i}") for name, n in (("a", 30), ("b", 50)) for i in range(n))
    assert records.numbered_text(spark, write(tmp_path / "none", "")).collect() == []


HARD = ['}', '{', '[', ']', '"', '\\', '\\"', 'a}b"{', '\\\\', ',', '}},{"id":1}', "é\n", " "]


def hard_records(n):
    rnd = random.Random(n)
    body = lambda depth: {rnd.choice(HARD) + str(k): (body(depth - 1) if depth and rnd.random() < 0.4 else rnd.choice([rnd.choice(HARD) * 3, [1, [{}], "]"], None, 1.5])) for k in range(rnd.randint(0, 3))}
    return [{"id": f"r{i}", "taskSpec": body(3)} for i in range(n)]


@pytest.mark.parametrize("indent,n", [(None, 0), (None, 25), (2, 12)])
def test_arrays_equal_json(spark, tmp_path, ranges, n, indent):
    given = hard_records(n)
    path = write(tmp_path / "a.json", "﻿ \n" + json.dumps(given, indent=indent, ensure_ascii=False) + "\n ")
    got = sorted((r.pos, r.id, r.body) for r in readers.read_task_records(spark, path).collect())
    assert got == [(i, r["id"], json.dumps(r["taskSpec"], ensure_ascii=False, separators=(",", ":"))) for i, r in enumerate(given)]


BAD = {
    "{}": "root", "[1]": "root", "[": "root", "": "end", '[{"id":"a","taskSpec":{}}': "end", '[{"id":"a","taskSpec":{}} {"id":"b","taskSpec":{}}]': "comma",
    '[{"id":"a","taskSpec":{}},]': "end", '[{"id":"a","taskSpec":{}}] x': "end", '[{"id":"a" "taskSpec":{}}]': "no JSON", '[{"id":"a","taskSpec":{"x":NaN}}]': "finite",
    '[{"id":"a","taskSpec":[]}]': "no object", '[{"id":"a","taskSpec":{"s":"open}]': "root", '[{"id":" a","taskSpec":{}}]': "bad id",
}


@pytest.mark.parametrize("text", list(BAD))
def test_bad_arrays_tell_why(spark, tmp_path, text):
    ship_package(spark)
    with pytest.raises(DataError, match=BAD[text]):
        readers.read_task_records(spark, write(tmp_path / "a.json", text))


def test_the_first_bad_record_or_line_is_told(spark, tmp_path, ranges):
    rows = hard_records(20)
    rows[15]["taskSpec"], rows[11]["taskSpec"] = 1, 2
    with pytest.raises(DataError, match="'pos': 11"):
        readers.read_task_records(spark, write(tmp_path / "a.json", json.dumps(rows)))
    lines = [json.dumps({"id": f"i{k}", "designCompactDsl": f"card {k}"}) + "\n" * (k % 3) for k in range(24)]
    good = readers.read_labels(spark, write(tmp_path / "l.jsonl", "\n".join(lines)))
    places = {line: i for i, line in enumerate("\n".join(lines).split("\n"))}
    assert {r.pos: r.label for r in good.collect()} == {places[line.strip()]: f"card {k}" for k, line in enumerate(lines)}
    for bad, what in (('{"id":', "bad line"), (json.dumps({"id": "i3", "designCompactDsl": "x"}), "repeated id"), (json.dumps({"id": "z", "designCompactDsl": "```"}), "bad label")):
        wrong = lines[:20] + [bad] + lines[20:]
        at = "\n".join(lines[:20]).count("\n") + 1
        with pytest.raises(DataError, match=f"{what}.*'pos': {at}"):
            readers.read_labels(spark, write(tmp_path / "l.jsonl", "\n".join(wrong)))


def test_both_cases_of_a_piece():
    assert records.advance('[{"a":{', False) == (2, False) and records.advance('x"', True) == (-1, False)
    assert records.advance('"open', False) == (0, True) and records.advance('\\"', True) == (0, True) and records.advance("a\\", True) == (0, True)
