"""The card language on columns: one Arrow function a document, then sets for what joins and counts."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context, document, reverse, rows

_OUTCOME = "struct<ok:boolean,error_type:string,error:string,text:string>"


def _outcome(function, *arrays: pa.Array) -> pa.Array:
    out = []
    for values in zip(*(a.to_pylist() for a in arrays)):
        try:
            out.append({"ok": True, "error_type": None, "error": None, "text": function(*values)})
        except (rows.CardError, ValueError, TypeError, AttributeError, RecursionError) as e:
            out.append({"ok": False, "error_type": getattr(e, "kind", "invalid"), "error": str(e), "text": None})
    kind = pa.struct([("ok", pa.bool_()), ("error_type", pa.string()), ("error", pa.string()), ("text", pa.string())])
    return pa.array(out, kind)


def _once(function, kind: str):
    """An Arrow function that a filter on its result does not run a second time: Spark moves and repeats deterministic ones."""
    return F.arrow_udf(function, kind).asNondeterministic()


#: Tasks a core that cards are dealt out to.
TASKS = 4


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out evenly to all cores by its key: a card is few bytes and much work, so a file that is one task to read is many to work on."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, key)


def to_document(card: Column, size: Column) -> Column:
    """ok, error_type, error and text: the document of a card."""
    return _once(lambda c, s: _outcome(document.to_document, c, s), _OUTCOME)(card, size)


def to_card(text: Column, size: Column) -> Column:
    return _once(lambda c, s: _outcome(reverse.to_card, c, s), _OUTCOME)(text, size)


def expand_tokens(card: Column) -> Column:
    return _once(lambda c: _outcome(document.expand_tokens, c), _OUTCOME)(card)


def verify(text: Column, size: Column) -> Column:
    """The round-trip report of a document as JSON in ``text``."""
    return _once(lambda c, s: _outcome(lambda d, z: document.compact(reverse.verify(d, z)[2]), c, s), _OUTCOME)(text, size)


@lru_cache(maxsize=256)
def _spec(text: str):
    """A task or specification; many cards have one, and nobody changes it."""
    return json.loads(text)


def check_context(card: Column, task: Column, card_spec: Column) -> Column:
    """Context warnings as a JSON list in ``text``; task and specification are JSON texts."""
    one = lambda c, x, y: json.dumps(context.check_context(c, _spec(x), _spec(y)))
    return _once(lambda *a: _outcome(one, *a), _OUTCOME)(card, task, card_spec)


def mend(card: Column, task: Column, card_spec: Column) -> Column:
    one = lambda c, x, y: context.mend(c, _spec(x), _spec(y))
    return _once(lambda *a: _outcome(one, *a), _OUTCOME)(card, task, card_spec)


def expression_paths(expression: Column) -> Column:
    """Paths of an expression, or null if its tokens are not in order."""

    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else rows.expression_paths({"expression": v}))
            except rows.CardError:
                out.append(None)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(expression)


def written_binding(path: Column) -> Column:
    return F.format_string("{{ ${%s} }}", path)


def bound_path(text: Column) -> Column:
    """The path of a written path binding, null for other text."""
    found = F.regexp_extract(text, r"^\{\{ \$\{(/[^{}]+)\} \}\}$", 1)
    return F.when(F.length(found) > 0, found)


_ROW = "case string, pos int, kind string, id string, type string, children array<string>, path string, body string"


def card_rows(cards: DataFrame, case: str, card: str) -> DataFrame:
    """A row for each component and data row of each card: ``case, pos, kind, id, type, children, path, body``.

    A card that does not read gives one row of kind ``error``, with the kind of
    error as type and its message as body.
    """

    def run(batches):
        for b in batches:
            out = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    read = rows.read_card(text)
                except (rows.CardError, ValueError, TypeError, AttributeError, RecursionError) as e:
                    out.append((name, 0, "error", None, getattr(e, "kind", "invalid"), None, None, str(e)))
                    continue
                for pos, c in enumerate(read.components):
                    out.append((name, pos, "component", c.id, c.type, list(c.children), None, document.compact(c.props)))
                for pos, d in enumerate(read.data, len(read.components)):
                    out.append((name, pos, "data", None, None, None, d.path, document.compact(d.value)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            cols = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _ROW.split(", ")])

    return cards.select(F.col(case).cast("string"), F.col(card)).mapInArrow(run, _ROW)


def _exploded(df: DataFrame, function, schema: str, names: list[str]) -> DataFrame:
    kind = f"array<struct<{schema}>>"
    return df.withColumn("_rows", F.arrow_udf(lambda v: pa.array([[dict(zip(names, r)) for r in function(x)] for x in v.to_pylist()], pa.list_(pa.struct([(n, pa.string()) for n in names]))), kind)(F.col("_text")))


def schema_paths(tasks: DataFrame, case: str, schema: str) -> DataFrame:
    """``case, path, kind`` of each declared node, for joins with bindings."""
    flat = _exploded(tasks.select(F.col(case).alias("case"), F.col(schema).alias("_text")), lambda x: context.flatten_schema(json.loads(x)) if x else [], "path:string,kind:string", ["path", "kind"])
    return flat.select("case", F.explode("_rows").alias("r")).select("case", "r.path", "r.kind")


def bindings(parsed: DataFrame) -> DataFrame:
    """``case, id, path`` of every binding of ``card_rows``; list indexes as 0, as schemas have one template."""
    flat = _exploded(parsed.where("kind = 'component'").withColumn("_text", F.col("body")), lambda x: [(p,) for p in rows.binding_paths(json.loads(x))], "path:string", ["path"])
    found = flat.select("case", "id", F.explode("_rows").alias("r")).select("case", "id", F.col("r.path").alias("path"))
    return found.withColumn("schema_path", F.regexp_replace("path", r"/\d+(?=/|$)", "/0"))


def undeclared_bindings(parsed: DataFrame, declared: DataFrame) -> DataFrame:
    """Bindings whose path no schema of the case declares."""
    known = declared.select("case", F.col("path").alias("schema_path")).distinct()
    # Sorted and merged: Spark takes ``known``, which grows with the cases, for a small share of the packed files and would broadcast it.
    return bindings(parsed).join(known.hint("merge"), ["case", "schema_path"], "left_anti")
