"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

A leaf is the SHA-256 of a row's fields; every FANOUT consecutive nodes become
the SHA-256 of their digests, as hex text, until one remains. Leaves are
numbered in their group (``with_ordinal``), so aligned blocks of FANOUT**DEPTH
leaves are groups of bounded size that tasks hash side by side: a block is one
contiguous matrix of 64-byte digests, reshaped by the fanout and hashed row by
row, a level at a time. The blocks' tops are the next, much smaller table. On
the way down every block takes the path above it and finds its own siblings by
index arithmetic in the same matrices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinal
from .common import pin

FANOUT, DEPTH = 8, 4
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "code string, pos long, steps array<struct<left:string,right:string>>, subroot string, root string"
_LEAF = "doc_id {kind}, leaf string, subroot string, root string, "
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else byte count, colon and value."""
    text = [f.cast("string") for f in fields]
    told = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.sha2(F.concat(*told), 256)


def matrix(digests) -> np.ndarray:
    """Hex digests as one contiguous matrix, a row of 64 bytes each."""
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def level_above(nodes: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """The digests of every run of ``fanout`` rows; the last run may be shorter."""
    whole = len(nodes) // fanout * fanout
    runs = list(nodes[:whole].reshape(-1, 64 * fanout))
    if whole < len(nodes):
        runs.append(nodes[whole:].reshape(-1))
    return matrix(hashlib.sha256(r.data).hexdigest() for r in runs)


def block_levels(nodes: np.ndarray, first: bool, fanout: int = FANOUT, depth: int = DEPTH) -> list[np.ndarray]:
    """The levels of an aligned block from its nodes to its top. A first block that is not full is its group's only one: it ends where one node remains."""
    out = [nodes]
    while len(out) <= depth and not (first and len(out[-1]) == 1):
        out.append(level_above(out[-1], fanout))
    return out


class Siblings:
    """The siblings of each node of a block, by index arithmetic in its levels."""

    def __init__(self, levels: list[np.ndarray], fanout: int = FANOUT):
        self.levels = [m.tobytes().decode("ascii") for m in levels[:-1]]
        place = np.arange(len(levels[0]))
        self.bounds = []
        for m in levels[:-1]:
            start = place // fanout * fanout
            self.bounds.append((start * 64, place * 64, np.minimum(start + fanout, len(m)) * 64))
            place = place // fanout

    def of(self, i: int) -> list[tuple[str, str]]:
        """(left, right) of node i at each level, each the concatenated digests."""
        return [(d[s[i] : p[i]], d[p[i] + 64 : e[i]]) for d, (s, p, e) in zip(self.levels, self.bounds)]


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    """The digest at the top, from one below and its siblings."""
    for left, right in steps:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def proof_digest(steps: list[tuple[str, str]]) -> str:
    return hashlib.sha256("".join(x for step in steps for x in step).encode()).hexdigest()


def _sorted_block(table: pa.Table, size: int) -> pa.Table:
    table = table.sort_by("pos")
    pos = table["pos"].to_numpy()
    if not np.array_equal(pos, pos[0] // size * size + np.arange(len(pos))):
        raise ValueError("a block has gaps or doubles")
    return table


def _up(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``code, pos, digest`` of the blocks' tops."""
    size = fanout**depth

    def top(table: pa.Table) -> pa.Table:
        table = _sorted_block(table, size)
        block = table["block"][0].as_py()
        digest = block_levels(matrix(table["digest"].to_pylist()), block == 0, fanout, depth)[-1].tobytes().decode("ascii")
        return pa.table({"code": [table["code"][0].as_py()], "pos": [block], "digest": [digest]})

    slim = nodes.select("code", "pos", "digest", F.expr(f"pos div {size}").alias("block"))
    return slim.groupBy("code", "block").applyInArrow(top, "code string, pos long, digest string")


def _down(nodes: DataFrame, paths: DataFrame, fanout: int, depth: int, rows, schema: str) -> DataFrame:
    """``rows(block, siblings, above)`` for each block of ``nodes`` and the row of ``paths`` that stands above it."""
    size = fanout**depth

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = _sorted_block(block, size)
        levels = block_levels(matrix(block["digest"].to_pylist()), block["pos"][0].as_py() == 0, fanout, depth)
        return rows(block, Siblings(levels, fanout), above.to_pylist()[0])

    left = nodes.withColumn("block", F.expr(f"pos div {size}")).groupBy("code", "block")
    right = paths.withColumn("block", F.col("pos")).groupBy("code", "block")
    return left.cogroup(right).applyInArrow(run, schema)


def _path_rows(block: pa.Table, siblings: Siblings, above: dict) -> pa.Table:
    upper = [(s["left"], s["right"]) for s in above["steps"]]
    steps = [[{"left": a, "right": b} for a, b in siblings.of(i) + upper] for i in range(len(block))]
    n = len(block)
    return pa.table({"code": block["code"], "pos": block["pos"], "steps": pa.array(steps, _STEPS), "subroot": pa.array([above["subroot"]] * n, pa.string()), "root": [above["root"]] * n})


def _ladder(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """Written tables ``code, pos, digest``, each the tops of the one before, until every code has one node."""
    out = [nodes]
    while out[-1].where("pos > 0").limit(1).count():
        out.append(pin(_up(out[-1], fanout, depth)))
    return out


def _leaves(docs: DataFrame, group: str, fields: tuple[str, ...], tampered: Column | None) -> DataFrame:
    """``doc_id, code, pos, digest, tampered`` of each row: its place in its group by doc_id, then digest."""
    code = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    other = F.lit(None).cast("string") if tampered is None else tampered
    slim = pin(docs.select("doc_id", code.alias("code"), leaf_digest([F.col(f) for f in fields]).alias("digest"), other.alias("tampered")))
    # rows alike in everything are dealt out by their place in the written table, so no run of them meets in one task
    slim = slim.withColumn("row", F.monotonically_increasing_id())
    return with_ordinal(slim, ["doc_id", "digest", "tampered", "row"], "pos", 0, ["code"]).drop("row")


def _paths_above(leaves: DataFrame, fanout: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """``leaves`` again and the paths above their blocks."""
    trees = _ladder(leaves.select("code", "pos", "digest"), fanout, depth)
    subroots = pin(with_ordinal(trees[-1].select("code", F.col("code").alias("lang_code"), "digest"), ["lang_code"]).withColumn("code", F.lit("")))
    crown = _ladder(subroots.select("code", "pos", "digest"), fanout, depth)
    paths = crown[-1].select("code", "pos", F.array().cast("array<struct<left:string,right:string>>").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(crown[:-1]):
        paths = pin(_down(nodes, paths, fanout, depth, _path_rows, _PATH))
    named = subroots.select("pos", F.col("lang_code"), F.col("digest"))
    paths = pin(paths.join(named, "pos").select(F.col("lang_code").alias("code"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("subroot"), "root"))
    for nodes in reversed(trees[1:-1]):
        paths = pin(_down(nodes, paths, fanout, depth, _path_rows, _PATH))
    return leaves, paths


def inclusion_proofs(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """The manifest itself: ``doc_id, leaf, subroot, root, steps`` of each row; ``steps`` are its siblings (left, right) from the leaf to the root.

    See ``audit_manifest`` for the tree and odd rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(block: pa.Table, siblings: Siblings, above: dict) -> pa.Table:
        told = _path_rows(block, siblings, above)
        return pa.table({"doc_id": block["doc_id"], "leaf": block["digest"], "subroot": told["subroot"], "root": told["root"], "steps": told["steps"]})

    leaves, paths = _paths_above(_leaves(docs, group, fields, None), fanout, depth)
    return _down(leaves, paths, fanout, depth, rows, _LEAF.format(kind=kind) + "steps array<struct<left:string,right:string>>")


def audit_manifest(docs: DataFrame, tampered: Column, group: str = "lang", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tampered`` is the digest of the row as it is delivered, null where it is
    as it was; ``folded_root`` folds that digest with the siblings of the
    untampered tree, and ``verified`` says whether it comes to the root. Leaves
    of a group stand by doc_id (null first), then digest; rows alike in both
    are interchangeable and keep a leaf each. Groups stand by their value as
    bytes, null first. Null fields differ from empty ones. Other columns are
    not read; no rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(block: pa.Table, siblings: Siblings, above: dict) -> pa.Table:
        upper, root, n = [(s["left"], s["right"]) for s in above["steps"]], above["root"], len(block)
        leaves, given = block["digest"].to_pylist(), block["tampered"].to_pylist()
        proofs, folded = [], []
        for i in range(n):
            steps = siblings.of(i) + upper
            proofs.append(proof_digest(steps))
            folded.append(fold(given[i] or leaves[i], steps))
        return pa.table({
            "doc_id": block["doc_id"], "leaf": block["digest"], "subroot": [above["subroot"]] * n, "root": [root] * n,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    leaves, paths = _paths_above(_leaves(docs, group, fields, tampered), fanout, depth)
    return _down(leaves, paths, fanout, depth, rows, _LEAF.format(kind=kind) + "proof_sha256 string, folded_root string, verified boolean")


def lower_cased_third(docs: DataFrame) -> Column:
    """The digest of a row whose text's A-Z are lower-cased, for rows whose crc32 of the doc_id as decimal text 3 divides; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col("text").cast("string"), upper, upper.lower())
    return F.when(chosen, leaf_digest([lowered if f == "text" else F.col(f) for f in FIELDS]))
