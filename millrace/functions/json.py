"""JSON in columns: canonical and stable text, pointers, strictness. Python only where key order or numbers' spelling must last."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _arrow(function, kind):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in values.to_pylist()], kind)

    return run


def _finite(value) -> bool:
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, dict):
        return all(map(_finite, value.values()))
    return all(map(_finite, value)) if isinstance(value, list) else True


def canonical_text(text: str) -> str | None:
    """Compact JSON in the given key order, or None if the text is no JSON or holds NaN or an infinity."""
    try:
        value = json.loads(text)
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except ValueError:
        return None


def stable_text(text: str) -> str | None:
    """Compact JSON with sorted keys; 1 and 1.0 stay apart."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False)
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    return F.arrow_udf(_arrow(canonical_text, pa.string()), "string")(text)


def stable_json(text: Column) -> Column:
    return F.arrow_udf(_arrow(stable_text, pa.string()), "string")(text)


def is_strict_json(text: Column) -> Column:
    """Whether a text is JSON with finite numbers. Repeated keys are allowed: the last counts."""
    return F.coalesce(F.try_parse_json(text).isNotNull() | canonical_json(text).isNotNull(), F.lit(False))


class PointerError(ValueError):
    pass


def pointer_parts(pointer: str) -> list[str]:
    """The tokens of a JSON pointer; ``/`` is the root. A tilde must be followed by 0 or 1."""
    if not pointer.startswith("/"):
        raise PointerError(f"a pointer starts with /: {pointer!r}")
    if re.search(r"~(?![01])", pointer):
        raise PointerError(f"bad escape in {pointer!r}")
    return [] if pointer == "/" else [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


MISSING = object()


def pointer_get(value, pointer: str):
    """What a pointer leads to, or MISSING. List indexes are digits only."""
    for part in pointer_parts(pointer):
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return MISSING
    return value


def pointer_text(document: str | None, pointer: str | None) -> str | None:
    """What a pointer leads to in a JSON text, as JSON; None if absent or malformed."""
    try:
        found = MISSING if document is None or pointer is None else pointer_get(json.loads(document), pointer)
    except ValueError:
        found = MISSING
    return None if found is MISSING else json.dumps(found, ensure_ascii=False, separators=(",", ":"))


def pointer_value(document: Column, pointer: str, kind: str = "string") -> Column:
    """The value at a fixed pointer of a JSON text, natively by way of variant_get; null if absent.

    Digits are a list's index or an object's key, whichever the text has there.
    """
    paths = ["$"]
    for part in pointer_parts(pointer):
        steps = ["['" + part.replace("'", "\\'") + "']"]
        if part.isdecimal() and part.isascii() and int(part) < 1 << 31:
            steps.append(f"[{int(part)}]")
        paths = [path + step for path in paths for step in steps]
    parsed = F.try_parse_json(document)
    return F.coalesce(*(F.try_variant_get(parsed, path, kind) for path in paths))


def pointer_values(document: Column, pointers: Column) -> Column:
    """JSON texts of what pointers, one a row, lead to; null if absent or malformed."""

    def run(docs: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(map(pointer_text, docs.to_pylist(), paths.to_pylist()), pa.string())

    return F.arrow_udf(run, "string")(document, pointers)
