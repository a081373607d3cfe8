from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import json as J
from millrace.functions import text as T


def values(spark, function, given):
    df = spark.createDataFrame([(v,) for v in given], "v string").coalesce(1)
    return [r[0] for r in df.select(function(F.col("v"))).collect()]


def test_numbers(spark):
    cases = {"-0.0": "0", "007": "7", ".5": "0.5", "-.50": "-0.5", "1,,2": "12", "0.5": "0.5", "1,200.00": "1200", "100": "100"}
    assert values(spark, T.canonical_number, list(cases)) == list(cases.values())
    long = ["123456789012345678901234567890123", "9" * 29 + ".5", "-" + "1" * 28 + "5", "1" * 27 + "25", "0.000" + "12345" * 7]
    assert values(spark, T.canonical_number, long) == [format(Decimal(x).normalize(), "f") for x in long]


def test_answers(spark):
    given = ["draft #### 1\nfinal #### 1,200.00", "1 + 1 = 2", "none", "#### ", "a -3.50 b"]
    assert values(spark, T.final_answer, given) == ["1200", "2", None, None, "-3.5"]


def test_strip_is_as_wide_as_pythons(spark):
    given = ["  a ", "\x1c b　\x1f", "c​", "\n\t", ""]
    assert values(spark, T.strip, given) == [x.strip() for x in given]


def test_failure_order(spark):
    rows = [("length", "", None), ("stop", "   ", None), ("stop", "dsl", "e"), ("stop", "dsl", None), (None, None, "e")]
    df = spark.createDataFrame(rows, "f string, t string, e string").coalesce(1)
    assert [r[0] for r in df.select(T.classify_failure(F.col("f"), F.col("t"), F.col("e"))).collect()] == ["truncated", "empty", "conversion_error", "unknown", "empty"]


def test_canonical_json_keeps_order_and_spelling(spark):
    given = ['{"b": 1, "a": 1.0, "c": "é"}', '{"a": NaN}', "nope", '{"a":1,"a":2}', None]
    assert values(spark, J.canonical_json, given) == ['{"b":1,"a":1.0,"c":"é"}', None, None, '{"a":2}', None]
    assert values(spark, J.stable_json, given)[0] == '{"a":1.0,"b":1,"c":"é"}'
    assert values(spark, J.is_strict_json, given) == [True, False, False, True, False]


def test_pointers(spark):
    doc = '{"a/b":{"~x":[1,{"y":null}]}}'
    for pointer, want in (("/", doc), ("/a~1b/~0x/0", "1"), ("/a~1b/~0x/1/y", "null"), ("/a~1b/~0x/9", None), ("/nope", None), ("bad", None), ("/a~2", None)):
        assert J.pointer_text(doc, pointer) == want
    with pytest.raises(J.PointerError):
        J.pointer_parts("/a~")
    assert values(spark, lambda c: J.pointer_value(c, "/a~1b/~0x/0", "int"), [doc]) == [1]
    assert values(spark, lambda c: J.pointer_value(c, "/a/0"), ['{"a":{"0":"key"}}', '{"a":["index"]}', '{"a":{}}', "no", None]) == ["key", "index", None, None, None]


def test_formats(spark):
    df = spark.createDataFrame([(0.5, 21.0, None)], "a double, b double, c double")
    row = df.select(T.format_percent(F.col("a")), T.format_metric(F.col("b")), T.format_metric(F.col("c"))).first()
    assert tuple(row) == ("50.00%", "21.00", "n/a")
