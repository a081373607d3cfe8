"""Corpus audits: manifests, duplicates, contamination, candidate use, structure, style, gates."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import written


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, problem``: files(path, size, sha256) against manifest(path, size, sha256); also repeats and absolute paths."""
    f = files.select(F.col("path").alias("f_path"), F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"))
    both = manifest.join(f, F.col("path") == F.col("f_path"), "full_outer")
    problem = (
        F.when(F.col("f_path").isNull(), "missing").when(F.col("path").isNull(), "unlisted").when(F.col("size") != F.col("f_size"), "size")
        .when(F.col("sha256") != F.col("f_sha"), "sha256").when(F.col("path").startswith("/") | F.col("path").contains(".."), "path")
    )
    direct = both.select(F.coalesce("path", "f_path").alias("path"), problem.alias("problem")).where("problem is not null")
    listed = manifest.groupBy("path").count().where("count > 1").select("path", F.lit("listed twice").alias("problem"))
    same = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1").select("path", F.lit("delivered twice").alias("problem"))
    return direct.unionByName(listed).unionByName(same)


def file_table(spark, folder: str) -> DataFrame:
    """path, size and SHA-256 of the files below a folder, through Spark's reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def exact_duplicates(df: DataFrame, text: str) -> DataFrame:
    """``sha256, copies`` of texts that occur more than once."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def conflicting_labels(df: DataFrame, text: str, label: str) -> DataFrame:
    """Equal texts with different labels."""
    return (
        df.groupBy(F.sha2(F.col(text), 256).alias("sha256"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(label).alias("low"), F.max(label).alias("high"))
        .where("low <> high")
    )


def word_ngrams(text: Column, n: int) -> Column:
    """Distinct n-word runs of the lower-case words, runs of letters, marks and digits of any script, of a text; fewer words are one run."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")

    def runs(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.least(F.size(w), F.lit(1))))
        return F.array_distinct(F.transform(heads, lambda _, i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))

    return F.element_at(F.transform(F.array(words), runs), 1)  # the words are a variable there, so they are split once


#: Cells that shingles are counted in to tell the common ones, and rows up to which a side of a join is broadcast.
CELLS, SLIM_ROWS = 1 << 20, 500_000


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _shingles(n: int):
    """Of each list of words, given as hashes, the distinct hashes of its n-word runs; fewer words are one run."""

    def run(batches):
        for b in batches:
            lists = b.column("w")
            words, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place, length = np.arange(len(words)) - np.repeat(offsets[:-1], sizes), np.repeat(sizes, sizes)
            hashes, of = [], []
            for k in range(1, n + 1):  # runs of k words: all of n, and the only run of a shorter text
                first = np.flatnonzero((place + k <= length) if k == n else (place == 0) & (length == k))
                h = np.full(len(first), k, np.uint64)
                for i in range(k):
                    h = (h ^ words[first + i]) * _STEP
                    h ^= h >> np.uint64(29)
                h *= _MIX
                hashes.append(h ^ (h >> np.uint64(32)))
                of.append(owner[first])
            h, of = np.concatenate(hashes).view(np.int64), np.concatenate(of)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            ends = np.searchsorted(of[new], np.arange(len(sizes) + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[new]))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), sets], ["key", "id", "s"])

    return run


def _heads(at_least: float, load: np.ndarray):
    """Of each set the s - ceil(t s) + 1 first shingles by the load of their cells, then by hash, with their places."""

    def run(batches):
        for b in batches:
            lists = b.column("s")
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes, first = np.diff(offsets), offsets[:-1] - offsets[0]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, load[values & (CELLS - 1)], owner))
            place = np.arange(len(values)) - np.repeat(first, sizes)
            kept = place < np.repeat(sizes - np.ceil(at_least * sizes - 1e-9).astype(np.int64) + 1, sizes)
            of = owner[order][kept]
            columns = [b.column("key").take(pa.array(of)), pa.array(sizes[of], pa.int32()), pa.array(place[kept], pa.int32()), pa.array(values[order][kept])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "p", "h"])

    return run


def _slim(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough."""
    df = written(df)
    return F.broadcast(df) if df.limit(SLIM_ROWS + 1).count() <= SLIM_ROWS else df


def near_duplicates(df: DataFrame, id_column: str, text: str, n: int = 5, at_least: float = 0.8) -> DataFrame:
    """``a, b, similarity``: pairs of different texts whose n-word shingle sets have this Jaccard similarity.

    Prefix filter: a set of size s must share one of its s - ceil(t s) + 1
    first shingles with any partner, in whatever order as long as it is one for
    all, so only those are shuffled and joined; the first one shared must leave
    enough behind it. Common shingles come last: the order goes by how many are
    in a shingle's cell, of CELLS, a table of fixed size that the tasks are given. Of equal
    texts the row of the least id counts. Texts and sets stay where they are
    read, three times; only sets of candidates move. A
    text of fewer than n words is one shingle, one without words has none and
    pairs with nothing. Texts are told apart by 128 bits of their hash, so two of one id
    are two; ``a`` and ``b`` are then equal.
    """
    key = F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16).alias("key")
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(id_column).alias("id"), F.col(text).alias("t"))
    copies = rows.select("key", "id").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key", "least")
    rows = rows.join(_slim(copies), "key", "left").where("least is null or id = least").drop("least")
    words = F.array_remove(F.split(F.lower("t"), r"[^\p{L}\p{M}\p{N}]+"), "")
    kind = rows.schema["id"].dataType.simpleString()

    def sets(of: DataFrame) -> DataFrame:
        hashed = of.select("key", "id", F.transform(words, lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
        return hashed.mapInArrow(_shingles(n), f"key binary, id {kind}, s array<long>")

    cell = F.col("h").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    cells = sets(rows).select(F.explode("s").alias("h")).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most CELLS rows
    load = np.zeros(CELLS, np.int64)
    load[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    keys = sets(rows).select("key", "s").mapInArrow(_heads(at_least, load), "key binary, n int, p int, h long").repartition("h").distinct()
    a, b = keys.alias("a"), keys.alias("b")
    enough = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) >= at_least / (1 + at_least) * (F.col("a.n") + F.col("b.n")) - 1e-6
    lean = (F.col("a.key") < F.col("b.key")) & (F.col("a.n") >= at_least * F.col("b.n")) & (F.col("b.n") >= at_least * F.col("a.n")) & enough
    pairs = written(a.join(b, (F.col("a.h") == F.col("b.h")) & lean).select(F.col("a.key").alias("one"), F.col("b.key").alias("other")).distinct())
    members = _slim(pairs.select(F.explode(F.array("one", "other")).alias("key")).distinct())
    wanted = written(sets(rows.join(members, "key", "left_semi")).dropDuplicates(["key"]))
    left, right = (wanted.select(F.col("key").alias(k), F.col("id").alias(i), F.col("s").alias(s)) for k, i, s in (("one", "ia", "sa"), ("other", "ib", "sb")))
    both = pairs.join(left, "one").join(right, "other")
    shared = F.size(F.array_intersect("sa", "sb"))
    told = both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"))
    return told.where(F.col("similarity") >= at_least)


def contamination(df: DataFrame, id_column: str, text: str, benchmark: DataFrame, item: str, item_text: str, n: int = 8) -> DataFrame:
    """``doc, item, shared``: how many distinct n-word runs of a benchmark item a document has."""
    ours = df.select(F.col(id_column).alias("doc"), F.explode(word_ngrams(F.col(text), n)).alias("g"))
    theirs = benchmark.select(F.col(item).alias("item"), F.explode(word_ngrams(F.col(item_text), n)).alias("g"))
    return ours.join(theirs, "g").groupBy("doc", "item").agg(F.count(F.lit(1)).alias("shared"))


#: Detectors that both this engine and RE2 read alike.
LEAK_PATTERNS = {
    "email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "local_path": r"/(?:home|mnt|tmp|Users)/[A-Za-z0-9._-]+",
    "template": r"\{\{.*?\}\}", "tool_log": r"(?:Traceback|stdout:|stderr:|exit code)",
}


def leak_counts(df: DataFrame, id_column: str, text: str, patterns: dict[str, str] = LEAK_PATTERNS) -> DataFrame:
    return df.select(id_column, *(F.regexp_count(F.col(text), F.lit(p)).cast("long").alias(k) for k, p in patterns.items()))


#: Offers whose items one task puts together.
TASK_ROWS = 250_000


def _items(offered: DataFrame, used: DataFrame, case: str, kind: str, item: str) -> DataFrame:
    """``case, kind, item, offered, used``: each item once, with whether it is offered and used. In one shuffle by case and kind.

    Items of a case are nearly all different, so they are not put together
    before the shuffle: a task would hold as many as it reads. After it a task
    holds those of TASK_ROWS offers, however many there are.
    """
    tasks = max(offered.sparkSession.sparkContext.defaultParallelism, -(-offered.count() // TASK_ROWS))
    told = lambda df, o, u: df.select(case, kind, item, F.lit(o).alias("offered"), F.lit(u).alias("used"))
    rows = told(offered, True, False).unionByName(told(used, False, True)).repartition(tasks, case, kind)
    return rows.groupBy(case, kind, item).agg(F.max("offered").alias("offered"), F.max("used").alias("used"))


def _cases(offered: DataFrame, used: DataFrame, case: str, kind: str, item: str) -> DataFrame:
    """``case, kind, n, k``: how many items are offered, and how many of them used. A null item, kind or case is never used."""
    whole = F.col(case).isNotNull() & F.col(kind).isNotNull() & F.col(item).isNotNull()
    items = _items(offered, used, case, kind, item).where("offered")
    return items.groupBy(case, kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("used") & whole).alias("k"))


def candidate_use(offered: DataFrame, used: DataFrame, case: str, kind: str, item: str) -> DataFrame:
    """``kind, offered, used, rate`` over cases that were offered items."""
    both = _cases(offered, used, case, kind, item)
    return both.groupBy(kind).agg(F.sum("n").alias("offered"), F.sum("k").alias("used"), (F.sum("k") / F.sum("n")).alias("rate"))


def use_classes(offered: DataFrame, used: DataFrame, case: str, kind: str, item: str) -> DataFrame:
    """``case, kind, class``: whether all, some or none of the offered items are used."""
    both = _cases(offered, used, case, kind, item)
    return both.select(case, kind, F.when(F.col("k") == 0, "none").when(F.col("k") == F.col("n"), "all").otherwise("partial").alias("class"))


def unused_positions(offered: DataFrame, used: DataFrame, case: str, item: str, pos: str) -> DataFrame:
    return offered.join(used.select(case, item).distinct(), [case, item], "left_anti").groupBy(pos).agg(F.count(F.lit(1)).alias("unused"))


def component_counts(components: DataFrame, kind: str = "type") -> DataFrame:
    return components.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("case").alias("cases"))


def _shape(cards: pa.Array) -> pa.Array:
    """Orphans and depth of each card, a list of ``id, children``."""
    out = []
    for card in cards.to_pylist():
        children = {c["id"]: c["children"] or [] for c in card}
        owned = set(chain.from_iterable(children.values()))
        depth, level = 0, {"root"} & children.keys()
        while level and depth < len(children):  # a path longer than the card goes in a circle
            depth, level = depth + 1, {x for i in level for x in children.get(i, ()) if x in children}
        out.append({"orphans": sum(c["id"] != "root" and c["id"] not in owned for c in card), "max_depth": depth})
    return pa.array(out, pa.struct([("orphans", pa.int64()), ("max_depth", pa.int32())]))


def structure_stats(components: DataFrame) -> DataFrame:
    """Per case, of ``components(case, id, type, children)``: size, single-child stacks, empty containers, orphans, depth.

    A case is one card, whose rows come together in one shuffle. Depth is the
    number of levels below and with the root, however many; it is 0 without a
    root, and the number of components if the links go in a circle.
    """
    per = components.groupBy("case").agg(
        F.count(F.lit(1)).alias("components"), F.count_if((F.col("type") == "Stack") & (F.size("children") == 1)).alias("single_child_stacks"),
        F.count_if(F.col("type").isin("Row", "Column", "List", "Stack") & (F.size("children") == 0)).alias("empty_containers"),
        F.collect_list(F.struct("id", "children")).alias("_card"),
    )
    shape = F.arrow_udf(_shape, "struct<orphans:long,max_depth:int>")(F.col("_card"))
    return per.withColumn("_shape", shape).select("case", "components", "single_child_stacks", "empty_containers", "_shape.*")


def style_stats(props: DataFrame, tokens: DataFrame) -> DataFrame:
    """Of ``props(case, id, name, value)``: how often each name has a token's value, and how often another."""
    hit = props.join(tokens.select("value").distinct().withColumn("is_token", F.lit(True)), "value", "left")
    return hit.groupBy("name").agg(F.count("is_token").alias("token_hits"), (F.count(F.lit(1)) - F.count("is_token")).alias("explicit"), F.countDistinct("value").alias("values"))


def batch_gate(issues: DataFrame, stages: DataFrame) -> DataFrame:
    """One row: counts by severity and whether the batch passes: no P0 issue, and every stage ``pass`` (not ``not_run``)."""
    worst = issues.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("P0", "P1", "P2")))
    runs = stages.agg(F.count(F.lit(1)).alias("stages"), F.count_if(F.col("status") == "pass").alias("passed"))
    return worst.crossJoin(runs).withColumn("batch_passes", (F.col("p0") == 0) & (F.col("passed") == F.col("stages")))  # one row against one row


def frozen_facts(literals: DataFrame, samples: DataFrame) -> DataFrame:
    """Text literals of a case that equal a sample value of its schema: facts frozen instead of bound."""
    return literals.join(samples.select("case", F.col("sample").alias("literal"), "path"), ["case", "literal"])
