"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is its bytes as the digits of a number in base r modulo a
prime, for two primes, beside its length. Chunks are hashed on their own and
combined by shifting with a power of r, in any order: a document of at least
HUGE_BYTES is dealt out in chunks to all tasks. Rows with one fingerprint are
then compared with their group's first row chunk by chunk; what differs goes on
as a group of its own, so a collision never merges two texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, SPACE_CLASS, fresh, pin, row_key, same_row, small, text_of

CHUNK = 1 << 16
#: Bytes of a text from which its chunks are hashed in tasks of their own.
HUGE_BYTES = 16 << 20
#: Two primes below 2**31 and a base for each.
MODULI, BASES = (2147483647, 2147483629), (911382323, 972663749)


def _powers(base: int, modulus: int) -> np.ndarray:
    """base**(CHUNK-1) ... base**0 modulo the prime."""
    out = np.ones(CHUNK, np.uint64)
    for i in range(1, CHUNK):
        out[i] = int(out[i - 1]) * base % modulus
    return out[::-1].copy()


_TABLES: list[np.ndarray] = []


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """The fingerprint of at most CHUNK bytes."""
    if not _TABLES:
        _TABLES.extend(_powers(b, m) for b, m in zip(BASES, MODULI))
    digits = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return tuple(int(np.dot(digits, t[CHUNK - digits.size :]) % m) for t, m in zip(_TABLES, MODULI))


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """The fingerprint of a concatenation from those of its parts."""
    return tuple((a * pow(r, right_length, m) + b) % m for a, b, r, m in zip(left, right, BASES, MODULI))


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)


def fingerprint(data: bytes) -> int:
    """Both residues in one integer below 2**62."""
    total = (0, 0)
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK]
        total = combine(total, chunk_hash(chunk), len(chunk))
    return total[0] << 31 | total[1]


def _body() -> Column:
    return F.encode(F.regexp_replace("text", f"[{SPACE_CLASS}]+", ""), "utf-8")


def fingerprints(docs: DataFrame, hash_bits: int = 62, huge: int = HUGE_BYTES) -> DataFrame:
    """``(doc_id, k1, k2, n_points, n_bytes, fp, sha)`` of each row, k1 and k2 its ``row_key``. ``hash_bits`` below 62 weakens the fingerprint, for tests."""
    low = (1 << hash_bits) - 1
    text = text_of(docs).cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *(k.alias(n) for k, n in zip(row_key(text), ("k1", "k2"))), text.alias("text"))

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(3):
                text = x.as_py()
                data = normalised(text)
                rows.append((len(text), len(data), fingerprint(data) & low, hashlib.sha256(data).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    def hashed(batches):
        for b in batches:
            parts = [chunk_hash(x.as_py()) for x in b.column(b.num_columns - 1)]
            pair = [pa.array([p[i] for p in parts], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *pair], [*b.schema.names[:-1], "a", "b"])

    def joined(chunks: pa.Array) -> pa.Array:
        out = []
        for row in chunks:
            total = (0, 0)
            for c in sorted(row.as_py(), key=lambda c: c["no"]):
                total = combine(total, (c["a"], c["b"]), c["n"])
            out.append((total[0] << 31 | total[1]) & low)
        return pa.array(out, pa.int64())

    names = ["doc_id", "k1", "k2", "n_points", "n_bytes", "fp", "sha"]
    short = rows.where(F.octet_length("text") < huge).mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, n_points long, n_bytes long, fp long, sha string")
    # rows alike in doc_id and text have the same chunks; they are told by how many first chunks there are
    key = ["doc_id", "k1", "k2", "n_points", "sha"]
    large = rows.where(F.octet_length("text") >= huge).withColumns({"n_points": F.length("text").cast("long"), "body": _body()}).withColumn("sha", F.sha2("body", 256))
    cut = large.withColumn("no", F.explode(F.sequence(F.lit(0), F.expr(f"cast(greatest(octet_length(body) - 1, 0) div {CHUNK} as int)"))))
    cut = cut.select(*key, "no", F.expr(f"substring(body, no * {CHUNK} + 1, {CHUNK})").alias("chunk")).withColumn("n", F.octet_length("chunk").cast("long")).select(*key, "no", "n", "chunk")
    parts = cut.repartition(F.xxhash64(*key, "no")).mapInArrow(hashed, f"doc_id {kind}, k1 long, k2 long, n_points long, sha string, no int, n long, a long, b long")
    whole = parts.groupBy(key).agg(F.collect_set(F.struct("no", "n", "a", "b")).alias("chunks"), F.count_if(F.col("no") == 0).alias("copies"))
    whole = whole.withColumns({"n_bytes": F.aggregate("chunks", F.lit(0).cast("long"), lambda t, c: t + c["n"]), "fp": F.arrow_udf(joined, "long")(F.col("chunks"))})
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return short.unionByName(whole.select(names))


def _first() -> Column:
    """What orders a group: the most code points, then the least doc_id, null last; then texts by hash, and rows alike in all of these by place."""
    return F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha", "k1", "k2", "row")


def _chunks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's normalised text in CHUNK bytes a row; an empty text gives no row."""
    rows = rows.select(*columns, _body().alias("body")).where("octet_length(body) > 0")
    at = F.explode(F.sequence(F.lit(0), F.expr(f"cast((octet_length(body) - 1) div {CHUNK} as int)")))
    return rows.withColumn("no", at).select(*columns, "no", F.expr(f"substring(body, no * {CHUNK} + 1, {CHUNK})").alias("chunk"))


_KEYS = ["fp", "n_bytes", "part"]


def _differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Of ``members(doc_id, k1, k2, sha, fp, n_bytes, part, first)`` those whose chunks differ from those of their group's first row, ``_id, _sha``."""
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    wanted = pin(members.select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "sha", *_KEYS, is_first.alias("is_first")).distinct())
    text = text_of(docs).cast("string")
    texts = docs.select("doc_id", text.alias("text"), *(k.alias(n) for k, n in zip(row_key(text), ("k1", "k2"))))
    # only the texts of groups with several rows go on
    rows = pin(same_row(texts, ["k1", "k2"], wanted, "inner").select("doc_id", "sha", *_KEYS, "is_first", "text"))
    cut = _chunks(rows, ["doc_id", "sha", *_KEYS, "is_first"])
    firsts = cut.where("is_first").select(*_KEYS, "no", F.col("chunk").alias("first_chunk")).dropDuplicates([*_KEYS, "no"])
    pairs = cut.where("not is_first").join(firsts, [*_KEYS, "no"])
    return pairs.where("chunk <> first_chunk").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).distinct()


def _verdicts(docs: DataFrame, hash_bits: int, huge: int) -> DataFrame:
    """``exact_duplicate_groups`` with each row's ``k1, k2``."""
    told = fingerprints(docs, hash_bits, huge).withColumns({"part": F.lit(0), "row": F.monotonically_increasing_id()})
    pending, settled, part = pin(told), [], 0  # the rows' numbers are written with them
    own = F.struct("doc_id", "k1", "k2", "sha", "row").alias("own")
    while pending is not None:
        groups = pin(pending.groupBy(_KEYS).agg(F.count(F.lit(1)).alias("group_size"), F.min(_first()).alias("first"), F.min(own).alias("own")))
        settled.append(groups.where("group_size = 1").select("own.*", "first", "group_size"))
        members = pin(pending.join(small(groups.where("group_size > 1").drop("own")), _KEYS))
        odd = pin(_differing(docs, members))
        part += 1
        if odd.isEmpty():
            same, pending = members, None
        else:  # a collision: who differs from the first row forms the next group
            mark, slim = small(odd), members.drop("first", "group_size")
            on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
            pending = pin(slim.join(mark, on, "left_semi").withColumn("part", F.lit(part)))
            alike = pin(slim.join(mark, on, "left_anti"))
            same = alike.join(small(pin(alike.groupBy(_KEYS).agg(F.count(F.lit(1)).alias("group_size"), F.min(_first()).alias("first")))), _KEYS)
        settled.append(same.select("doc_id", "k1", "k2", "sha", "row", "first", "group_size"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    kept = F.col("row") == F.col("first.row")
    return out.select("doc_id", "k1", "k2", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_duplicate_groups(docs: DataFrame, hash_bits: int = 62, huge: int = HUGE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they agree once ASCII white space is gone; null is
    empty. The row with the most code points stays, then the one with the least
    doc_id (null last), and exactly one of each group: of rows alike in both
    the one with the least hash of its text, of rows alike in all any one.
    ``group_size`` counts rows. No rows give no rows; other columns are not
    read. Groups come from partial aggregates and joins only, whatever their
    size, and only texts that share a fingerprint are moved.
    """
    return _verdicts(docs, hash_bits, huge).drop("k1", "k2")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that ``exact_duplicate_groups`` keeps.

    Rows are told apart by doc_id and text; of rows alike in both that stay,
    one stays. A null text is an empty one; no rows give no rows; other columns
    stay as they are.
    """
    told = _verdicts(docs, 62, HUGE_BYTES).where("group_size > 1")
    keyed = pin(told.groupBy("doc_id", "k1", "k2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    named = [F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")]
    gone, again = pin(keyed.where("not kept").select(*named)), pin(keyed.where("kept and n > 1").select(*named))
    own = fresh(docs, "own_k1", "own_k2")
    marked = docs.select(*docs.columns, *(k.alias(name) for k, name in zip(row_key(text_of(docs).cast("string")), own)))
    left = same_row(marked, own, gone, "left_anti")
    if again.isEmpty():
        return left.select(docs.columns)
    repeated = same_row(marked, own, again, "left_semi").dropDuplicates(["doc_id", *own])
    return same_row(left, own, again, "left_anti").unionByName(repeated).select(docs.columns)
