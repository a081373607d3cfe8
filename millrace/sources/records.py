"""Text records of files of any size, read by many tasks: numbered lines, and the elements of a JSON array.

Spark's text reader cuts files into byte ranges and completes the line, or
whatever a separator ends, that straddles a cut. What it does not tell is where
in the file a row stands. Rows are numbered inside their range; ranges are
counted, and the running sum of the counts over one row a range gives the rest.

A JSON array is read in pieces that end with ``}``. Whether such a brace ends a
record depends on what comes before: on the nesting depth and on being inside a
string. Every range works out both cases side by side; the ranges' effects are
then composed in order, again over one row a range, and tell which case holds.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_folder

_RANGE = ["path", "block"]


def written_once(df: DataFrame) -> DataFrame:
    """Both passes must see the same ranges, so what is read is written once."""
    out = work_folder(df.sparkSession)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _ranged(lines: DataFrame, whole: bool = False) -> DataFrame:
    """``path, block, value, at``; with ``whole`` all files are one, of no path, whose ranges go by file and start."""
    file, start = F.col("_metadata.file_path"), F.format_string("%020d", F.col("_metadata.file_block_start"))
    path, block = (F.lit(""), F.concat_ws(":", file, start)) if whole else (file, start)
    return lines.select(path.alias("path"), block.alias("block"), "value", F.monotonically_increasing_id().alias("at"))


def _running(blocks: DataFrame, n: str) -> DataFrame:
    """``path, block`` and the sum of ``n`` over the ranges before it in its file."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*_RANGE, "first", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("ahead"))


def numbered_text(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """``path, line_number, value`` of text files: every line, blank ones too, from 1 in each file.

    A byte-order mark at the start of a file is no part of its first line. No
    lines give no rows. Lines are not shuffled; the ranges' counts, one row a
    range, are joined to them. With ``whole`` the files, in the order of their
    names, are the parts of one text, cut at line ends.
    """
    lines = written_once(_ranged(spark.read.text(path), whole))
    blocks = lines.groupBy(*_RANGE).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    placed = lines.join(F.broadcast(_running(blocks, "n")), _RANGE)
    return placed.select("path", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line_number"), F.regexp_replace("value", "^\ufeff", "").alias("value"))


_IN_STRING = re.compile(r'(?:[^"\\]|\\.)*', re.DOTALL)


def advance(piece: str, inside: bool) -> tuple[int, bool]:
    """What a piece and the brace after it do: the change of nesting depth, and whether a string is open at the brace, which then counts as text."""
    depth, at = 0, 0
    while True:
        if inside:
            at = _IN_STRING.match(piece, at).end()
            if at >= len(piece) or piece[at] != '"':
                return depth, True
            inside, at = False, at + 1
        quote = piece.find('"', at)
        plain = piece[at:] if quote < 0 else piece[at:quote]
        depth += plain.count("{") + plain.count("[") - plain.count("]")
        if quote < 0:
            return depth - 1, False
        inside, at = True, quote + 1


def _both_cases(batches):
    """Per piece the depth and the string state after it, counted from the start of its range, if the range starts outside and inside a string."""
    where, plain, quoted = None, (0, False), (0, True)
    for b in batches:
        out = []
        for path, block, piece in zip(*(b.column(i).to_pylist() for i in range(3))):
            if (path, block) != where:
                where, plain, quoted = (path, block), (0, False), (0, True)
            (a, in_a), (c, in_c) = advance(piece, plain[1]), advance(piece, quoted[1])
            plain, quoted = (plain[0] + a, in_a), (quoted[0] + c, in_c)
            out.append((*plain, *quoted))
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*b.schema.names, "depth0", "open0", "depth1", "open1"])


def _compose(ranges: pa.Table) -> pa.Table:
    """The depth and string state that each range of a file starts with."""
    ranges = ranges.sort_by("block")
    depth, inside, starts = 0, False, []
    for r in ranges.to_pylist():
        starts.append((depth, inside))
        more, inside = (r["depth1"], r["open1"]) if inside else (r["depth0"], r["open0"])
        depth += more
    return pa.table({"path": ranges["path"], "block": ranges["block"], "depth": [d for d, _ in starts], "inside": [i for _, i in starts]})


def array_elements(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """``path, pos, text, last`` of the objects in JSON array files, by place from 0; texts hold the comma or bracket before them.

    ``last`` marks what follows the last object of a file, which should be its
    closing bracket. Whether a text is sound JSON is not looked at, see
    ``element_of``. Nothing is larger in a task than a byte range or an object.
    With ``whole`` the files, in the order of their names, are the parts of one
    array, each but the last cut right after a ``}``.
    """
    read = _ranged(spark.read.option("lineSep", "}").text(path), whole)
    pieces = written_once(read.mapInArrow(_both_cases, "path string, block string, value string, at long, depth0 long, open0 boolean, depth1 long, open1 boolean"))
    end = F.max_by(F.struct("depth0", "open0", "depth1", "open1"), "at").alias("end")
    ranges = pieces.groupBy(*_RANGE).agg(end).select(*_RANGE, "end.*")
    starts = ranges.groupBy("path").applyInArrow(_compose, "path string, block string, depth long, inside boolean")
    told = pieces.join(F.broadcast(starts), _RANGE)  # one row a range
    depth = F.col("depth") + F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    text_goes_on = F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0"))
    told = told.select(*_RANGE, "at", "value", (~text_goes_on & (depth == 1)).cast("long").alias("ends"))
    ends = told.groupBy(*_RANGE).agg(F.sum("ends").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # inside one byte range
    told = told.withColumn("here", F.coalesce(F.sum("ends").over(before), F.lit(0))).join(F.broadcast(_running(ends, "n")), _RANGE)
    parts = told.groupBy("path", (F.col("here") + F.col("ahead")).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"), F.max("ends").alias("ended"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "}")
    return parts.select("path", "pos", F.when(F.col("ended") == 1, F.concat(text, F.lit("}"))).otherwise(text).alias("text"), (F.col("ended") == 0).alias("last"))


_LEAD = {True: re.compile(r"\ufeff?[ \t\r\n]*\[[ \t\r\n]*"), False: re.compile(r"[ \t\r\n]*,[ \t\r\n]*")}
_CLOSE = {True: re.compile(r"\ufeff?[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*"), False: re.compile(r"[ \t\r\n]*\][ \t\r\n]*")}


def element_of(pos: int, text: str, last: bool) -> tuple[str | None, str | None]:
    """(the object's own text, problem): the bracket or comma before it is taken off; the last text must close the array."""
    first = pos == 0
    if last:
        return None, None if _CLOSE[first].fullmatch(text) else "the root is no array of objects, or it does not end"
    lead = _LEAD[first].match(text)
    if not lead:
        return None, "the root is no array of objects" if first else "no comma between records"
    return text[lead.end() :], None
