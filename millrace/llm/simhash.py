"""SimHash near-duplicates through an inverted index over fingerprint bytes.

A fingerprint has eight bytes. Two that differ in at most three bits differ in
at most three bytes, so they share at least five bytes in place: five is the
guaranteed minimum of matches. One position's byte would make postings of a
256th of all fingerprints, so the index lists each fingerprint under its 56
choices of five (position, byte) entries: two fingerprints meet there exactly
if their tally can reach the minimum, and no posting can be common. Where they
meet the tally of shared positional bytes is taken, pairs under the minimum go,
and the rest is verified by bits. Only links to the least reached fingerprint
leave, never all pairs. A posting fixes 40 of the 64 bits, so it has at most
2**24 members however many documents there are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, pin, row_key, same_row
from .graph import connected_components

BITS, BYTES, MAX_DIFF = 64, 8, 3
#: Bytes that a pair within MAX_DIFF bits is sure to share.
MIN_SHARED = BYTES - MAX_DIFF
SHINGLE, SEED = 3, 42
MASKS = [
    sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(BYTES), MIN_SHARED)
]


#: Shingle width and least Jaccard similarity of near copies in drop_near_duplicates; its min-wise keys and hashes in each.
COPY_SHINGLE, SIMILARITY, BANDS, BAND = 5, 0.8, 32, 5
#: Shingles of the sets compared in one task, and postings of one key held in one: larger groups are dealt out.
TASK_SHINGLES, TASK_POSTINGS = 4_000_000, 1_000_000
_RANDOM = np.random.default_rng(SEED)
#: Odd factors of the min-wise hashes, of the hashes in a key, and of index keys.
FACTORS, MIX = (_RANDOM.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * BAND, BAND + 2))


def shingle_hashes(text: str | None, width: int = SHINGLE):
    """XXH64 (seed 42) of a text's word shingles, in arrays. Fewer words than ``width`` are one shingle; no word, none."""
    tail, some = [], False
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for block in blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + block.split()
        hashes = [digest(join(x), SEED) for x in zip(*(words[i:] for i in range(width)))]
        if hashes:
            some = True
            yield np.array(hashes, np.uint64)
        tail = words[max(0, len(words) - width + 1) :]
    if tail and not some:
        yield np.array([digest(join(tail), SEED)], np.uint64)


def majority(parts) -> int:
    """The 64-bit SimHash of shingle hashes: their majority bit by bit. No hash: 0."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles. No word: 0."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each row's whole text as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of fingerprints agree in place."""
    differ = (a ^ b)[:, None].view(np.uint8)
    return BYTES - np.count_nonzero(differ, axis=1)


def near_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs pass the count filter and, verified bit by bit, are within MAX_DIFF."""
    near = tally(a, b) >= MIN_SHARED
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= MAX_DIFF
    return near


def posting_links(members: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Star links that join what is within MAX_DIFF bits, step by step, among distinct fingerprints."""
    links, left = [], members
    while left.size > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and left.size:
            near = near_pairs(left, np.full(left.size, front.pop(), np.uint64))
            if near.any():
                links.append((root, left[near]))
                front.extend(left[near])
                left = left[~near]
    return links


def _link_postings(batches):
    """Over rows sorted by posting: the links inside each. A posting may span batches."""
    kept: list[np.ndarray] = []

    def solve(rows: np.ndarray):
        place, mask, fp = rows
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (mask[1:] != mask[:-1])])
        lengths = np.diff(np.r_[starts, len(fp)])
        u, v = [], []
        two = starts[lengths == 2]
        a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        near = near_pairs(a, b)
        u.append(a[near])
        v.append(b[near])
        for at, n in zip(starts[lengths > 2], lengths[lengths > 2]):
            for root, hits in posting_links(np.unique(fp[at : at + n]).view(np.uint64)):
                u.append(np.full(hits.size, root, np.uint64))
                v.append(hits)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"]
        )

    for b in batches:
        if not b.num_rows:
            continue
        kept.append(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
        last, first = kept[-1][:2, -1], kept[-1][:2, 0]
        if (first == last).all() and len(kept) > 1 and (kept[-2][:2, -1] == last).all():
            continue
        rows = np.concatenate(kept, axis=1)
        cut = int(np.flatnonzero((rows[:2] != last[:, None]).any(axis=0))[-1]) + 1 if (rows[:2] != last[:, None]).any() else 0
        kept = [rows[:, cut:]]
        if cut:
            yield solve(rows[:, :cut])
    if kept:
        yield solve(np.concatenate(kept, axis=1))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` → ``(u, v)``: links that connect all fingerprints within MAX_DIFF bits, in steps."""
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in MASKS)))
    postings = distinct.select(keys.alias("place", "mask"), "fp")
    return (
        postings.repartition("place", "mask")
        .sortWithinPartitions("place", "mask")
        .mapInArrow(_link_postings, "u long, v long")
        .distinct()
    )


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Rows link if their fingerprints differ in at most three bits;
    ``component_id`` is the least doc_id that links reach. A null or wordless
    text has fingerprint zero and links like any other. Equal texts, ties and
    repeated rows share fingerprint and component. A null doc_id gets a row and
    counts for a component only if it has no other. Other columns are not read.
    No rows give no rows.
    """
    marked = pin(fingerprints(docs))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    stars = connected_components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def candidate_keys(members: np.ndarray, fp: int) -> np.ndarray:
    """The index keys of a shingle set: its min-wise bands, and the byte positions of its SimHash."""
    if not members.size:
        return np.zeros(0, np.uint64)
    least = np.full(FACTORS.size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, members.size, 1024):
        least = np.minimum(least, (members[at : at + 1024, None] * FACTORS).min(axis=0))
    bands = (least.reshape(BANDS, BAND) * MIX[:BAND]).sum(axis=1, dtype=np.uint64)
    bytewise = (np.array(MASKS, np.uint64) & np.uint64(fp)) * MIX[BAND]
    keys = np.concatenate([bands, bytewise])
    return keys + np.arange(keys.size, dtype=np.uint64) * MIX[BAND + 1]


def candidate_index(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, sid, keys`` of each row: a hash of its text in two parts, one of its shingle set, and index keys."""

    def run(batches):
        for b in batches:
            sids, keys, ends = [], [], [0]
            for x in b.column(3):
                parts = list(shingle_hashes(x.as_py(), COPY_SHINGLE))
                members = shingle_set(parts)
                sids.append(xxhash.xxh64_intdigest(members.tobytes(), SEED))
                keys.append(candidate_keys(members, majority(parts)))
                ends.append(ends[-1] + keys[-1].size)
            flat = np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            ids = pa.array(np.array(sids, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids, listed], ["doc_id", "k1", "k2", "sid", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    k1, k2 = row_key(F.col("text").cast("string"))
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, sid long, keys array<long>")


def _runs(batches, column: int = 0):
    """Tables of whole runs of one key, over rows sorted by it. A run may span batches."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if kept and kept[0].column(column)[0] != b.column(column)[b.num_rows - 1]:
            key = b.column(column).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            yield pa.Table.from_batches([*kept, b.slice(0, cut)])
            kept = [b.slice(cut)]
        elif kept:
            kept.append(b)
        else:
            key = b.column(column).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield pa.Table.from_batches([b.slice(0, cut)])
            kept = [b.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]


def _sign(data: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64).view(np.int64)


def _shared_buckets(batches, most: int = TASK_POSTINGS):
    """``(bucket, sid)`` where a key has several sets, over rows sorted by key; keys with the same sets give the same bucket.

    The sets of a key that has more than ``most`` leave as they come, under a bucket of its own.
    """

    def solve(key, sid):
        ends, buckets, sids = _bounds(key), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(np.diff(ends) > 1):
            found = np.unique(sid[ends[i] : ends[i + 1]])
            if found.size > 1:
                buckets.append(np.repeat(_sign(found.tobytes()), found.size))
                sids.append(found)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (buckets, sids)], ["bucket", "sid"])

    def pass_on(key, sid):
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(_sign(b"key" + key.tobytes()), sid.size)), pa.array(sid)], ["bucket", "sid"])

    held, large = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
    for b in batches:
        key, sid = (b.column(i).to_numpy() for i in range(2))
        if large is not None:
            same = int(np.searchsorted(key, large, "right"))
            yield pass_on(large, sid[:same])
            key, sid = key[same:], sid[same:]
        if not key.size:
            continue
        large, key, sid = None, np.concatenate([held[0], key]), np.concatenate([held[1], sid])
        cut = int(np.searchsorted(key, key[-1]))
        yield solve(key[:cut], sid[:cut])
        held = key[cut:], sid[cut:]
        if held[0].size > most:
            large = key[-1]
            yield pass_on(large, held[1])
            held = held[0][:0], held[1][:0]
    if held[0].size:
        yield solve(*held)


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Star links, by place, that join the sets whose Jaccard similarity is at least SIMILARITY, step by step."""
    sizes, links = np.array([s.size for s in sets]), []
    left = np.arange(len(sets))
    while left.size > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and left.size:
            at = front.pop()
            fits = left[np.minimum(sizes[left], sizes[at]) >= SIMILARITY * np.maximum(sizes[left], sizes[at]) - 1e-6]
            if not fits.size:
                continue
            near = []
            for some in np.array_split(fits, 1 + int(sizes[fits].sum()) // 1_000_000):
                if not some.size:
                    continue
                values = np.concatenate([sets[i] for i in some])
                hit = sets[at][np.minimum(np.searchsorted(sets[at], values), sizes[at] - 1)] == values
                shared = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
                near.append(some[shared / (sizes[at] + sizes[some] - shared) >= SIMILARITY])
            near = np.concatenate(near)
            links.extend((int(root), int(i)) for i in near)
            front.extend(near)
            left = left[~np.isin(left, near)]
    return links


def _verified_links(batches):
    """``(u, v)`` of sets linked by similarity, over ``(bucket, sid, members)`` sorted by bucket."""
    for table in _runs(batches):
        sid, ends = table.column(1).to_numpy(), _bounds(table.column(0).to_numpy())
        members, u, v = table.column(2), [], []
        for start, end in zip(ends[:-1], ends[1:]):
            for a, b in similar_links([np.frombuffer(x.as_py(), np.uint64) for x in members.slice(start, end - start)]):
                u.append(sid[start + a])
                v.append(sid[start + b])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], ["u", "v"])


def _sets(batches):
    """``(sid, members, n)`` from ``(sid, text)``."""
    for b in batches:
        held = [shingle_set(list(shingle_hashes(x.as_py(), COPY_SHINGLE))) for x in b.column(1)]
        members, sizes = pa.array([x.tobytes() for x in held], pa.binary()), pa.array([x.size for x in held], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), members, sizes], ["sid", "members", "n"])


def _similarities(batches):
    """``(sid, leader, similarity)`` from ``(sid, leader, members, led)``."""
    for b in batches:
        out = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
            shared = np.intersect1d(x, y, assume_unique=True).size
            out.append(shared / max(1, x.size + y.size - shared))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["sid", "leader", "similarity"])


def _split_buckets(rows: DataFrame, sets: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Buckets ``(bucket, sid, n)`` too large for a task → links ``(u, v)`` to their leaders, and smaller buckets ``(bucket, sid)`` for the rest.

    Each set is compared with its bucket's leader, the least. Those near it are
    linked and need not be compared with each other. Jaccard distance is a
    metric, so only the near ones as far out as the distance of the others
    less 1 - SIMILARITY can be near any of them. Others are compared with
    these and each other, in cells of a block of each: no link is lost.
    """
    led = rows.join(rows.groupBy("bucket").agg(F.min("sid").alias("leader")), "bucket").where("sid <> leader")
    pairs = led.select("sid", "leader").distinct().join(sets.select("sid", "members"), "sid")
    pairs = pairs.join(sets.select(F.col("sid").alias("leader"), F.col("members").alias("led")), "leader").select("sid", "leader", "members", "led")
    scored = pin(pairs.mapInArrow(_similarities, "sid long, leader long, similarity double"))
    judged = pin(led.join(scored, ["sid", "leader"]).withColumn("near", F.col("similarity") >= SIMILARITY))
    reach = judged.where("not near").groupBy("bucket").agg(
        (F.max("similarity") + (1 - SIMILARITY) + 1e-9).alias("most"), F.ceil(F.sum("n") / most).cast("int").alias("others"),
    )
    rest = judged.join(reach, "bucket").where("not near or similarity <= most")
    nears = rest.where("near").groupBy("bucket").agg(F.ceil(F.sum("n") / most).cast("int").alias("nears"))
    rest = rest.join(nears, "bucket", "left").fillna(0, ["nears"])
    block = lambda of: F.pmod(F.xxhash64("sid"), F.greatest(F.col(of), F.lit(1)))
    numbers = lambda of: F.when(F.col(of) > 0, F.sequence(F.lit(0), F.col(of) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda kind, a, b: F.xxhash64("bucket", F.lit(kind), a.cast("long"), b.cast("long"))
    own, near_own = block("others"), block("nears")
    cells = F.when(F.col("near"), F.transform(numbers("others"), lambda i: cell("near", i, near_own))).otherwise(
        F.concat(
            F.transform(numbers("others"), lambda i: cell("others", F.least(own, i.cast("long")), F.greatest(own, i.cast("long")))),
            F.transform(numbers("nears"), lambda i: cell("near", own, i)),
        )
    )
    return scored.where(F.col("similarity") >= SIMILARITY).select(F.col("leader").alias("u"), F.col("sid").alias("v")), rest.select(F.explode(cells).alias("bucket"), "sid")


def similarity_links(docs: DataFrame, index: DataFrame, most: int = TASK_SHINGLES) -> DataFrame:
    """``(u, v)``: links that connect, in steps, all shingle sets of ``index`` that are near copies."""
    one = index.groupBy("sid").agg(F.first("keys").alias("keys"))
    shared = (
        one.select(F.explode("keys").alias("key"), "sid").repartition("key").sortWithinPartitions("key")
        .mapInArrow(_shared_buckets, "bucket long, sid long")
    )
    buckets = pin(shared.distinct())
    first = index.join(buckets.select("sid").distinct(), "sid").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))).alias("r"))
    k1, k2 = row_key(F.col("text"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("k1", k1).withColumn("k2", k2)
    wanted = same_row(texts, ["k1", "k2"], pin(first.select("sid", "r.*")), "inner").select("sid", "text")
    sets = pin(wanted.mapInArrow(_sets, "sid long, members binary, n long")).dropDuplicates(["sid"])
    sized = buckets.join(sets.select("sid", "n"), "sid")
    large = pin(sized.groupBy("bucket").agg(F.sum("n").alias("weight")).where(F.col("weight") > most).select("bucket"))
    if large.isEmpty():
        return _compared(buckets, sets)
    links, cells = _split_buckets(pin(sized.join(large, "bucket").select("bucket", "sid", "n")), sets, most)
    alone = buckets.join(large, "bucket", "left_anti").unionByName(cells)
    return _compared(alone, sets).unionByName(links).distinct()


def _compared(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v)``: the links inside each bucket ``(bucket, sid)``, which one task holds."""
    rows = buckets.join(sets, "sid").select("bucket", "sid", "members")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verified_links, "u long, v long").distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies, the one with the least doc_id.

    Texts are near copies if the Jaccard similarity of their sets of five-word
    shingles is at least 0.8; classes are what such links reach. Texts without
    words are copies of each other. Rows are told apart by doc_id and text, so
    one that repeats a doc_id with another text is judged by that text; of rows
    alike in both one stays. A null doc_id is no least one: of a class's rows
    without doc_id one stays beside the one with the least.
    """
    index = pin(candidate_index(docs))
    stars = connected_components(similarity_links(docs, index))
    rooted = index.drop("keys").join(stars.select(F.col("u").alias("sid"), F.col("v").alias("root")), "sid", "left")
    rooted = pin(rooted.select("doc_id", "k1", "k2", F.coalesce("root", "sid").alias("root"), F.col("doc_id").isNull().alias("no_id")))
    row = F.struct("doc_id", "k1", "k2")
    least = rooted.groupBy("root", "no_id").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone = rooted.join(least, ["root", "no_id"]).where(~row.eqNullSafe(F.col("least")))
    again = rooted.join(least, ["root", "no_id"]).where(row.eqNullSafe(F.col("least"))).groupBy("doc_id", "k1", "k2").count().where("count > 1")
    named = [F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")]
    gone, again = pin(gone.select(*named).distinct()), pin(again.select(*named))
    own = fresh(docs, "own_k1", "own_k2")
    marked = docs.select(*docs.columns, *(k.alias(name) for k, name in zip(row_key(F.col("text").cast("string")), own)))
    plain = same_row(same_row(marked, own, gone, "left_anti"), own, again, "left_anti")
    repeated = same_row(marked, own, again, "left_semi").dropDuplicates(["doc_id", *own])
    return plain.unionByName(repeated).select(docs.columns)
