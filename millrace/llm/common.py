"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: ASCII white space, as a regular-expression class body and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it; a session in which all run on one machine gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(df[name], F.lit(""))


def blocks(data: bytes, size: int = 1 << 20):
    """Cut ``data`` into blocks of about ``size`` bytes at ASCII white space."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + size, end)
        while to < end and data[to] not in SPACE_BYTES:
            to += 1
        yield data[at:to]
        at = to


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, like ``names``, that ``df`` does not have in any spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows up to which the slim side of a join with texts is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written slim table, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def row_key(text) -> list[Column]:
    """Two hashes that tell texts with one doc_id apart."""
    return [F.xxhash64(text), F.xxhash64(F.lit("row"), text)]


def same_row(left: DataFrame, own: list[str], right: DataFrame, how: str) -> DataFrame:
    """Join by doc_id and both parts of the text's hash, ``own`` in ``left``; ``right``, a written table, has them as ``_id, _k1, _k2``."""
    names = fresh(left, "row_id", "row_k1", "row_k2")
    right = small(right).withColumnsRenamed(dict(zip(("_id", "_k1", "_k2"), names)))
    on = F.col("doc_id").eqNullSafe(F.col(names[0]))
    return left.join(right, on & (F.col(own[0]) == F.col(names[1])) & (F.col(own[1]) == F.col(names[2])), how)
