import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, best, checks, compare, launch, messages, pairing, ranking, stats
from millrace.operators.checks import DataError


def test_run_report(spark):
    rows = [(True, 1000.0, 10, 32, None), (True, 2000.0, 20, 48, None), (False, 3000.0, 30, 64, "truncated")]
    df = spark.createDataFrame(rows, "ok boolean, latency_ms double, prompt_tokens int, completion_tokens int, error_type string")
    r = stats.run_report(df, 6500.0).first()
    assert (r.total, r.success, r.failed) == (3, 2, 1) and math.isclose(r.success_rate, 2 / 3)
    assert (r.latency_p50, r.latency_p95, r.completion_max) == (2000.0, 3000.0, 64.0)
    assert math.isclose(r.successful_per_second, 2 / 6.5)
    assert [tuple(x) for x in stats.failure_counts(df).collect()] == [("truncated", 1)]
    empty = stats.run_report(df.limit(0), 0.0).first()
    assert empty.success_rate == 0.0 and empty.latency_p50 is None and empty.requests_per_second is None


def test_percentiles(spark):
    for n, want in ((1, (1, 1)), (4, (2, 4)), (5, (3, 5)), (20, (10, 19))):
        df = spark.range(1, n + 1)
        assert tuple(df.agg(stats.nearest_rank("id", 0.5), stats.nearest_rank("id", 0.95)).first()) == want
        got = {r.share: r.value for r in stats.rounded_rank_percentiles(df, "id", [0.5, 0.95]).collect()}
        assert got == {q: sorted(range(1, n + 1))[round((n - 1) * q)] for q in (0.5, 0.95)}


def test_ranks_of_groups_by_narrowing(spark):
    from millrace.operators import selection

    rnd = random.Random(3)
    kinds = {"big": lambda: rnd.randrange(-(2**62), 2**62), "near": lambda: 2**60 + rnd.randrange(5), "same": lambda: 7, "small": lambda: rnd.randrange(-3, 900)}
    rows = [(g, make()) for g, make in kinds.items() for _ in range(rnd.randint(150, 400))] + [("one", 5), ("none", None), (None, 1), (None, 3)]
    ranks = {"low": selection.nearest(0.1), "mid": selection.nearest(0.5), "also": F.lit(3), "top": F.col("n") * 2}
    rows += [("wide", -(2**63)), ("wide", 2**63 - 1), ("wide", 0), ("wide", -1)]
    for cells in (16, 4096):
        got = {(r.g, r.name): r.value for r in selection.select_ranks(spark.createDataFrame(rows, "g string, v long").repartition(5), "v", ranks, ["g"], cells).collect()}
        want = {}
        for g in {g for g, _ in rows} - {"none"}:
            v = sorted(x for h, x in rows if h == g and x is not None)
            at = {"low": math.ceil(len(v) * 0.1) - 1, "mid": math.ceil(len(v) * 0.5) - 1, "also": min(3, len(v) - 1), "top": len(v) - 1}
            want |= {(g, k): v[i] for k, i in at.items()}
        assert got == want
    floats = [(x,) for x in (1e300, -1e300, 1e-300, 0.0, -0.5, 2.5, 2.5, float("nan"), None, float("inf"), float("-inf"))]
    got = {r.name: r.value for r in selection.select_ranks(spark.createDataFrame(floats, "v double"), "v", {str(i): F.lit(i) for i in range(9)}).collect()}
    assert [got[str(i)] for i in range(9)] == [float("-inf"), -1e300, -0.5, 0.0, 1e-300, 2.5, 2.5, 1e300, float("inf")]
    assert selection.select_ranks(spark.createDataFrame([], "v double"), "v", {"a": F.lit(0)}).collect() == []


def test_short_texts_are_one_shingle(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, "one two three  four!"), (3, "one two three"), (4, ""), (5, "x"), (5, "X.")], "id int, t string")
    assert {(r.a, r.b) for r in audit.near_duplicates(df, "id", "t").collect()} == {(1, 2), (5, 5)}
    items = spark.createDataFrame([(9, "Three four"), (8, "absent words"), (7, "")], "item int, t string")
    assert {(r.doc, r.item) for r in audit.contamination(df, "id", "t", items, "item", "t", 2).collect()} == {(1, 9), (2, 9)}


def test_group_advantage(spark):
    rows = [(1, i, r) for i, r in enumerate((1.0, 0.0, 0.0, 0.0))] + [(2, i, 1.0) for i in range(4)]
    got = {(r.g, r.i): r.advantage for r in stats.group_advantage(spark.createDataFrame(rows, "g int, i int, reward double"), ["g"], "reward").collect()}
    assert abs(got[1, 0] - 1.499997) < 1e-6 and abs(got[1, 1] + 0.499999) < 1e-6 and got[2, 0] == 0.0


def test_split_sizes():
    for n, ratio, want in ((64, 0.05, 32), (65, 0.9, 32), (96, 0.99, 64), (100, 0.5, 64), (954, 0.05, 32), (960, 0.05, 64), (1000, 0.05, 64), (1000, 0.1, 96), (10000, 0.05, 512)):
        assert ranking.validation_size(n, ratio) == want
    assert ranking.validation_size(5, 0) == 0
    for n, ratio in ((63, 0.1), (100, 1.0)):
        with pytest.raises(DataError):
            ranking.validation_size(n, ratio)


def test_splits_are_exact(spark):
    df = spark.range(954).withColumnRenamed("id", "doc")
    a = {r.doc for r in ranking.split_by_hash(df, "doc", 0.05).where("is_validation").collect()}
    assert len(a) == 32 and a == {r.doc for r in ranking.split_by_hash(df.repartition(5), "doc", 0.05).where("is_validation").collect()}
    ids = list(range(954))
    random.Random(42).shuffle(ids)
    b = {r.doc for r in ranking.split_by_shuffle(df, "doc", "doc", 0.05).where("is_validation").collect()}
    assert b == set(ids[:32])
    assert ranking.holdout(spark.range(7473), "id", 0.1).where("is_validation").count() == 748


def test_probe_cycles(spark):
    got = ranking.memory_probe(spark.createDataFrame([("a", 5), ("b", 9), ("c", 9)], "id string, n int"), "id", "n", 2, 5).orderBy("probe").collect()
    assert [r.id for r in got] == [f"{x}__oom_probe_{i:04d}" for i, x in enumerate("bcbcb")]


def test_best_so_far(spark):
    losses = [(1, s, x) for s, x in enumerate((5.0, 4.8, float("nan"), 4.4, 4.39, 3.0))]
    df = spark.createDataFrame(losses, "run int, step int, loss double")
    assert best.best_so_far(df, ["run"], "step", "loss", 0.5).first().accepted_steps == [0, 3, 5]
    assert best.best_so_far(df, ["run"], "step", "loss").first().accepted_steps == [0, 1, 3, 4, 5]


def test_pairing(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int"), spark.createDataFrame([("y", 3), ("x", 4)], "id string, w int")
    assert [tuple(r) for r in pairing.pair_one_to_one(a, b, "id", "v").collect()] == [("x", 1, 4), ("y", 2, 3)]
    with pytest.raises(DataError, match="unmatched"):
        pairing.pair_one_to_one(a, b.where("id = 'x'"), "id")


def test_transitions_and_bootstrap(spark):
    rows = [(0, False, True), (1, True, False), (2, True, True), (3, False, False)]
    df = spark.createDataFrame(rows, "index int, b boolean, a boolean")
    assert tuple(compare.transitions(df, "b", "a").first()) == (1, 1, 1, 1)
    assert {tuple(r) for r in compare.turned(df, "index", "b", "a").collect()} == {(0, "improved"), (1, "regressed")}
    d = [1, -1, 0, 0, 1, 1, 0, 1]
    rng = random.Random(7)
    means = sorted(sum(d[rng.randrange(8)] for _ in range(8)) / 8 for _ in range(500))
    want = (means[round(499 * 0.025)], means[round(499 * 0.975)])
    df = spark.createDataFrame(list(enumerate(d)), "i long, v int")
    assert tuple(compare.bootstrap_exact(df, "i", "v", 500, 7).first()) == want
    low, high = compare.bootstrap_by_hash(df, "i", "v", 300).first()
    assert low <= sum(d) / 8 <= high


def test_messages(spark):
    df = spark.createDataFrame([(" q ", " a #### 1 ")], "q string, a string")
    m = df.select(messages.question_messages(F.col("q"), F.col("a"), "Show.").alias("messages"))
    assert [tuple(x) for x in m.first().messages] == [("user", "q Show."), ("assistant", "a #### 1")]
    assert m.select(checks.messages_ok(roles=checks.MATH_ROLES, marker="####")).first()[0]
    assert not m.select(checks.messages_ok(roles=checks.PROMPT_ROLES)).first()[0]
    e = spark.createDataFrame([([1, 2], [1, 2, 3])], "p array<int>, f array<int>")
    r = messages.encode_example(e, "p", "f", 2).first()
    assert (r.position_ids, r.loss_mask, r.too_long) == ([0, 1, 2], [0, 0, 1], True)
    assert e.select(checks.prompt_is_prefix("p", "f")).first()[0]
    assert messages.normal_ids({"input_ids": [[4, 5]]}) == [4, 5]


def test_prefixes(spark):
    p = spark.createDataFrame([(0, "/data/a/b"), (0, "/data/ab"), (0, "/x")], "c int, path string")
    r = spark.createDataFrame([(0, "/data/a"), (0, "/data"), (0, "/never")], "c int, root string")
    assert {x.path: x.covering_root for x in pairing.cover_by_prefix(p, r, ["c"]).collect()} == {"/data/a/b": "/data/a", "/data/ab": "/data", "/x": None}
    assert [x.root for x in pairing.unused_roots(p, r, ["c"]).collect()] == ["/never"]


def test_audits(spark):
    files = spark.createDataFrame([("a", 1, "s1"), ("b", 2, "s2"), ("c", 3, "s2")], "path string, size long, sha256 string")
    listed = spark.createDataFrame([("a", 1, "s1"), ("b", 9, "s2"), ("d", 1, "s9"), ("a", 1, "s1")], "path string, size long, sha256 string")
    assert {tuple(r) for r in audit.manifest_check(files, listed).collect()} == {("b", "size"), ("d", "missing"), ("c", "unlisted"), ("a", "listed twice"), ("b", "delivered twice")}
    rnd = random.Random(2)
    base = ["w%d" % rnd.randrange(50) for _ in range(80)]
    texts = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate((3, 40, 70))] + [(9, " ".join(reversed(base)))]
    got = {(r.a, r.b): r.similarity for r in audit.near_duplicates(spark.createDataFrame(texts, "id int, t string"), "id", "t").collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    assert got == {k: v for k, v in want.items() if v >= 0.8}


def test_launch_arithmetic():
    assert launch.launch_plan(16, 2, 32, 2, 4096, 4096) == {"data_parallel": 8, "local_batch": 4, "accumulation": 2}
    with pytest.raises(DataError):
        launch.launch_plan(16, 2, 30, 2, 4096, 4096)


@pytest.mark.parametrize("cast", ["long", "double"])
def test_bootstrap_draws_in_parts_and_pieces_like_one_generator(spark, monkeypatch, cast):
    monkeypatch.setattr(compare, "WORDS", 64)
    monkeypatch.setattr(compare, "GROUPS", 7)
    d = [(i * 37) % 11 - 5 for i in range(150)]
    rng = random.Random(3)
    means = sorted(sum(d[rng.randrange(150)] for _ in range(150)) / 150 for _ in range(40))
    want = (means[round(39 * 0.025)], means[round(39 * 0.975)])
    df = spark.createDataFrame(list(enumerate(d)), "i long, v long").withColumn("v", F.col("v").cast(cast)).repartition(5)
    assert tuple(compare.bootstrap_exact(df, "i", "v", 40, 3).first()) == want
    monkeypatch.setattr(compare, "PIECE_VALUES", 64)
    monkeypatch.setattr(compare, "BLOCK_VALUES", 16)
    assert tuple(compare.bootstrap_exact(df, "i", "v", 40, 3).first()) == want
    starts = list(compare._starts(150, [0, 5, 40], 3))
    assert [s[:3] for s in starts] == [(0, 0, 5), (1, 5, 40)]  # states only: no task holds the draws
    assert compare.bootstrap_exact(df.where("i < 0"), "i", "v", 40, 3).collect() == []


def test_near_duplicates_move_only_the_first_shingles(spark):
    rnd = random.Random(4)
    common = " ".join("licence%d" % (i % 40) for i in range(60))  # a passage that all texts share
    base = [" ".join("w%d" % rnd.randrange(9000) for _ in range(200)) for _ in range(30)]
    texts = [(i, f"{common} {t}") for i, t in enumerate(base)] + [(100 + i, f"{common} {t} end{i}") for i, t in enumerate(base[:5])]
    texts += [(200 + i, texts[0][1]) for i in range(20)] + [(0, texts[0][1])]  # copies, one of the same id
    df = spark.createDataFrame(texts, "id int, t string")
    assert sorted((r.a, r.b) for r in audit.near_duplicates(df, "id", "t").collect()) == [(i, 100 + i) for i in range(5)]
    load = np.zeros(audit.CELLS, np.int64)
    load[7 & (audit.CELLS - 1)] = 99  # 7 is common, so it is the last of its set
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([list(range(20))], pa.list_(pa.int64()))], ["key", "s"])
    (out,) = audit._heads(0.8, load)([batch])
    assert out.to_pydict() == {"key": [b"k"] * 5, "n": [20] * 5, "p": [0, 1, 2, 3, 4], "h": [0, 1, 2, 3, 4]}
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([[7, 8]], pa.list_(pa.int64()))], ["key", "s"])
    assert next(audit._heads(0.8, load)([batch])).column("h").to_pylist() == [8]


def test_tasks_hold_a_bounded_number_of_offers(spark, monkeypatch):
    monkeypatch.setattr(audit, "TASK_ROWS", 500)
    offered = spark.range(10_000).selectExpr("id div 4 as c", "'k' as kind", "if(id = 3, null, id) as item").coalesce(1)
    items = audit._items(offered, offered.where("item % 2 = 0"), "c", "kind", "item")
    sizes = items.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 20 and sum(sizes) == 10_000 and max(sizes) < 1000
    assert [tuple(r) for r in audit.candidate_use(offered, offered.where("item % 2 = 0"), "c", "kind", "item").collect()] == [("k", 10_000, 5000, 0.5)]
    nothing = spark.createDataFrame([(1, "k", None)], "c long, kind string, item long")
    assert audit.use_classes(nothing, nothing, "c", "kind", "item").first()["class"] == "none"
