"""Shards under a byte limit by extendible hashing, in DataFrame operations only.

A directory is indexed by hash-prefix bits. A bucket over the limit splits on
one more bit; the others stay. Here a pass counts all open buckets eight bits
deeper at once, rolls the counts up to find each one's first prefix that fits,
settles those rows and goes on with the rest. Counts are pre-aggregated, and a
pass reads a slim table, never the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin

LIMIT_BYTES, STEP_BITS, MAX_BITS = 8 << 20, 8, 63
#: Low bits of the code that come from the row's place, to part copies of one row.
COPY_BITS = 24


def _prefix(depth) -> F.Column:
    return F.expr(f"shiftrightunsigned(code, 64 - ({depth}))")


def row_code(text: str = "text", key: str = "doc_id") -> F.Column:
    """The 64 bits whose prefixes index the directory: a hash of key and text, the low COPY_BITS one of the row's place."""
    low = (1 << COPY_BITS) - 1
    place = F.xxhash64(F.monotonically_increasing_id())
    content = F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string"))
    return content.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(place.bitwiseAND(F.lit(low).cast("long")))


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, text: str = "text", key: str = "doc_id", step: int = STEP_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, shard, depth, shard_bytes, oversize``.

    ``shard`` is the bucket's hash prefix in ``depth`` binary digits ('' for a
    lone bucket). The code hashes key and text and ends in bits of the row's
    place, so a key with a third of all rows, or copies of one row, split like
    any others. A bucket over the limit that holds one row, or that no bit up
    to 63 parts, is left as it is with ``oversize`` true. Null text has 0
    bytes; null keys are hashed like values; no rows give no rows.
    """
    slim = pin(docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), row_code(text, key).alias("code")))
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(MAX_BITS, max(1, (max(1, total) // limit).bit_length()) + 4)
    floor, open_rows, settled = 0, slim, []
    while True:
        fine = open_rows.groupBy(_prefix(depth).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        up = fine.withColumn("depth", F.explode(F.sequence(F.lit(floor), F.lit(depth)))).withColumn(
            "prefix", F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.expr(f"shiftrightunsigned(fine, {depth} - depth)"))
        )
        sums = up.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == MAX_BITS))
        leaf = up.join(fits.select("depth", "prefix", "shard_bytes"), ["depth", "prefix"]).groupBy("fine").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf")
        )
        found = open_rows.withColumn("fine", _prefix(depth)).join(leaf, "fine", "left")
        settled.append(found.where("leaf is not null").select("doc_id", "n_bytes", "leaf.*"))
        left = found.where("leaf is null").select("doc_id", "n_bytes", "code")
        if depth >= MAX_BITS:
            break
        open_rows = pin(left)
        if open_rows.isEmpty():
            break
        floor, depth = depth + 1, min(MAX_BITS, depth + step)
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')")).alias("shard"),
        F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"),
    )
