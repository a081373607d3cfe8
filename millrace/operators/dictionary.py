"""Searching texts for very many patterns at once.

The patterns, task queries, sample values or user names, become one automaton a
block of the dictionary, built where it is used, and every text is read once a
block. A block is bounded by patterns and by characters, so what is handed to
the tasks does not grow with the dictionary; the number of blocks does.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinals import with_ordinal

#: Patterns, and their code points, of one automaton.
BLOCK_PATTERNS, BLOCK_CHARS = 50_000, 20_000_000
#: Hits of one batch that goes back to Spark.
BATCH_HITS = 50_000


def automaton(patterns: list[tuple[str, list[str]]]):
    """The patterns, each with its kinds, as an automaton that finds all of them, overlapping or inside each other."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, kinds in patterns:
        found.add_word(pattern, (pattern, kinds))
    found.make_automaton()
    return found


_BUILT: dict[str, object] = {}


def _search(name: str, shared, kind: pa.DataType):
    fields = [("id", kind), ("kind", pa.string()), ("pattern", pa.string()), ("start", pa.int64()), ("end", pa.int64())]

    def run(batches):
        if name not in _BUILT:
            _BUILT.clear()  # one automaton a worker
            _BUILT[name] = automaton(shared.value)
        search = _BUILT[name].iter
        for b in batches:
            out = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for last, (pattern, kinds) in search(text):
                    out += [(id_, k, pattern, last + 1 - len(pattern), last + 1) for k in kinds]
                    if len(out) >= BATCH_HITS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])
                        out = []
            columns = list(zip(*out)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    return run


def dictionary_hits(df: DataFrame, id_column: str, text: str, patterns: DataFrame, most: int = BLOCK_PATTERNS, chars: int = BLOCK_CHARS) -> DataFrame:
    """``id, kind, pattern, start, end``: every place where a pattern of ``patterns(kind, pattern)`` stands in a text, in code points, end exclusive.

    Overlapping hits all count. A pattern of several kinds gives a row each;
    patterns that are null or empty are none, repeated ones are one. Null texts
    have no hits. ``id_column`` is a long or a string.
    """
    spark = df.sparkSession
    known = patterns.where(F.length("pattern") > 0).groupBy("pattern").agg(F.array_sort(F.collect_set(F.coalesce("kind", F.lit("")))).alias("kinds"))
    numbered = with_ordinal(known, ["pattern"])
    size = numbered.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("pattern")).alias("longest")).first()
    block = max(1, min(most, chars // max(1, size["longest"] or 1)))
    is_text = df.schema[id_column].dataType.simpleString() == "string"
    texts = df.select(F.col(id_column).cast("string" if is_text else "long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    schema = f"id {'string' if is_text else 'long'}, kind string, pattern string, start long, end long"
    out = None
    for first in range(0, max(1, size["n"]), block):
        rows = numbered.where((F.col("pos") >= first) & (F.col("pos") < first + block)).select("pattern", "kinds").collect()  # at most ``block``
        if not rows:
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast([(r["pattern"], list(r["kinds"])) for r in rows])
        one = texts.mapInArrow(_search(f"{shared._jbroadcast.id()}", shared, pa.string() if is_text else pa.int64()), schema)
        out = one if out is None else out.unionByName(one)
    return out


def leaks(df: DataFrame, id_column: str, text: str, patterns: DataFrame, **bounds) -> DataFrame:
    """``id, kind, pattern, first_at, hits``: one row for each text and pattern that stands in it."""
    hits = dictionary_hits(df, id_column, text, patterns, **bounds)
    return hits.groupBy("id", "kind", "pattern").agg(F.min("start").alias("first_at"), F.count(F.lit(1)).alias("hits"))
