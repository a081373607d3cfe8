"""Secret scans: sure patterns, and weak parts of a credential that vouch for each other.

An access identifier, a secret or an endpoint alone proves little. Within one
scope, the lines of a paragraph, the parts of a document are joined by
distance: a secret-like part within REACH code points of an identifier or an
endpoint, or an identifier near both a secret and an endpoint, is reported.
The join looks up the nearest part on either side among the sorted parts of a
scope, so a document with n parts costs n log n.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
#: Code points between two parts that still belong to one credential.
REACH = 200
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A named identifier, a long mixed run, and an endpoint.
WEAK_ID = re.compile(r"""(?:user(?:_?name|_?id)?|login|(?:client|account|access|app|key)_?id|access_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{4,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
WEAK_ENDPOINT = re.compile(r"""(?:endpoint|host|server|region|url|bucket)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:/_-]{4,})|(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s"'<>]+""", re.I | re.A)
_BREAK = re.compile(r"\n[\x20\x09\x0B-\x0D]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The sure spans (start, end, kind), by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span):
    return span[0], KINDS.index(span[2]), span[1]


def looks_random(run: str) -> bool:
    """At least three of: lower case, upper case, digit, sign; and many distinct characters."""
    classes = [any(map(str.islower, run)), any(map(str.isupper, run)), any(map(str.isdigit, run)), any(c in "+/_-=" for c in run)]
    return sum(classes) >= 3 and classes[2] and len(set(run)) * 2 >= min(len(run), 40)


def _weak_parts(text: str) -> list[tuple[int, int, str]]:
    parts = []
    if ":" in text or "=" in text:
        parts += [(m.start(), m.end(), "weak_id") for m in WEAK_ID.finditer(text)]
        parts += [(m.start(), m.end(), "weak_endpoint") for m in WEAK_ENDPOINT.finditer(text)]
    if parts or "AKIA" in text:
        parts += [(m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text) if looks_random(m[0])]
    return parts


_ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "weak_endpoint": "endpoint"}


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak parts that complementary parts within reach and scope vouch for; none that a base span covers."""
    tops = list(accumulate((b[1] for b in base), max))
    heads = [b[0] for b in base]

    def covered(span) -> bool:
        before = bisect_left(heads, span[1])
        return before > 0 and tops[before - 1] > span[0]

    weak = [w for w in _weak_parts(text) if not covered(w)]
    if not weak:
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    # by (scope, role): the starts in order, and the farthest end up to each
    starts, ends = {}, {}
    for s, e, k in sorted(base + weak):
        key = bisect_left(breaks, s), _ROLE[k]
        starts.setdefault(key, []).append(s)
        far = ends.setdefault(key, [])
        far.append(max(e, far[-1]) if far else e)

    def near(span, scope, role) -> bool:
        """Interval join: does a part of this role in this scope come within reach of the span?"""
        at = starts.get((scope, role))
        if not at:
            return False
        i = bisect_left(at, span[0])
        return i < len(at) and at[i] <= span[1] + reach or i > 0 and ends[scope, role][i - 1] >= span[0] - reach

    out = []
    for w in weak:
        scope, role = bisect_left(breaks, w[0]), _ROLE[w[2]]
        has = {r: near(w, scope, r) for r in ("id", "secret", "endpoint") if r != role}
        if (has["id"] or has["endpoint"]) if role == "secret" else has["secret"] and (role == "id" or has["id"]):
            out.append(w)
    return out


def _told(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``(doc_id, base, linked)``: arrays of ``(start, end, kind)`` of each row's whole text, in code points.

    A null text is empty and has none. Rows are scanned one by one: ties,
    repeated rows and null doc_ids change nothing; other columns are not read.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def rows(spans):
        return [{"start": s, "end": e, "kind": k} for s, e, k in spans]

    def run(batches):
        for b in batches:
            base, linked = [], []
            for x in b.column(1):
                text = x.as_py()
                sure = base_spans(text)
                base.append(rows(sure))
                linked.append(rows(sorted(linked_spans(text, sure, reach), key=_order)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(base, pa.list_(span)), pa.array(linked, pa.list_(span))], ["doc_id", "base", "linked"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:long,end:long,kind:string>>"
    return docs.select("doc_id", text_of(docs).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, base {spans}, linked {spans}")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` from the spans that ``scan`` gives."""
    told = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    rank = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    keyed = F.transform(F.concat("base", "linked"), lambda x: F.struct(x["start"], rank[x["kind"]].alias("rank"), x["end"], x["kind"]))
    return scan(docs).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform("base", told)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.array_sort(keyed), told)).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
