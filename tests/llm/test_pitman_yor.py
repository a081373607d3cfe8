"""The model against a plain sampler, exact seat counts, and the base against sums in plain Python."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import pitman_yor as py


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def brute_base(rows):
    counts = Counter(t for d, text in rows if not is_held_out(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text in rows:
        toks = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks)
        out.append((d, is_held_out(d), len(toks), sum(t in counts for t in toks), n, round(base, 6)))
    return sorted(out, key=str)


def run(docs, **options):
    return py.score_documents(docs, py.held_out_tenth(docs["doc_id"]), **options).collect()


def base_of(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


def corpus(n=300):
    rnd = random.Random(11)
    after = {w: rnd.sample("abcdefghijklmnopqrst", 4) for w in "abcdefghijklmnopqrst"}
    out = []
    for i in range(n):
        w, text = rnd.choice("abc"), []
        for _ in range(rnd.randint(0, 25)):
            text.append(w if rnd.random() < 0.95 else f"rare{rnd.randrange(500)}")
            w = rnd.choices(after[w], (8, 4, 2, 1))[0]
        out.append((i, " ".join(text)))
    return out


class Plain:
    """One restaurant after the other, one customer after the other."""

    def __init__(self, rows, sweeps=6, burn_in=3, seed=5):
        self.rnd = random.Random(seed)
        seqs = [tokens(t) for d, t in rows if not is_held_out(d)]
        self.v = len({t for s in seqs for t in s})
        customers = [(b, a) for s in seqs for b, a in zip([None] + s, s)]
        self.root, self.below = defaultdict(list), defaultdict(lambda: defaultdict(list))
        self.sums, self.n = [], 0
        for u, w in customers:
            self.add(u, w)
        self.samples = []
        for k in range(sweeps):
            for u, w in customers:
                self.remove(u, w)
                self.add(u, w)
            if k >= burn_in:
                self.samples.append(({w: list(t) for w, t in self.root.items()}, {u: {w: list(t) for w, t in d.items()} for u, d in self.below.items()}))

    @staticmethod
    def chance(room, dish, base, discount, strength):
        mine = room.get(dish, [])
        total, tables = sum(map(sum, room.values())), sum(map(len, room.values()))
        return (sum(mine) - discount * len(mine) + (strength + discount * tables) * base) / (strength + total)

    def sit(self, room, dish, base, discount, strength):
        mine = room[dish]
        weights = [n - discount for n in mine] + [(strength + discount * sum(map(len, room.values()))) * base]
        k = self.rnd.choices(range(len(weights)), weights)[0]
        if k == len(mine):
            mine.append(0)
        mine[k] += 1
        return mine[k] == 1

    def add(self, u, w):
        even = 1 / (self.v + 1)
        if self.sit(self.below[u], w, self.chance(self.root, w, even, *py.ROOT), *py.BELOW):
            self.sit(self.root, w, even, *py.ROOT)

    def leave(self, room, dish):
        mine = room[dish]
        k = self.rnd.choices(range(len(mine)), mine)[0]
        mine[k] -= 1
        if not mine[k]:
            mine.pop(k)
            return True
        return False

    def remove(self, u, w):
        if self.leave(self.below[u], w):
            self.leave(self.root, w)

    def score(self, text):
        total = 0.0
        seq = tokens(text)
        for u, w in zip([None] + seq, seq):
            ps = []
            for root, below in self.samples:
                base = self.chance(root, w, 1 / (self.v + 1), *py.ROOT)
                ps.append(self.chance(below[u], w, base, *py.BELOW) if u in below else base)
            total += math.log10(sum(ps) / len(ps))
        return total


@pytest.mark.parametrize("layout", [py.Layout(1), py.Layout(3), py.Layout(3, [(py.END >> 16, 2), (py.word_key("a") >> 16, 3)])])
def test_scores_agree_with_a_plain_sampler(make_docs, layout, monkeypatch):
    rows = corpus(160)
    plain = Plain(rows)
    got = {r.doc_id: r for r in run(make_docs(rows).repartition(3), layout=layout)}
    assert base_of(got.values()) == brute_base(rows)
    want = {d: plain.score(t) for d, t in rows}
    assert abs(sum(r.score for r in got.values()) / sum(want.values()) - 1) < 0.015
    assert max(abs(got[d].score - w) / got[d].n_tokens for d, w in want.items()) < 0.35
    assert np.corrcoef([got[d].score for d in want], list(want.values()))[0, 1] > 0.99
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got.values())


def stirling(c, t, d):
    """Ways to seat c customers at t tables, each weighted by its sizes' factors."""
    if c == 0 or t == 0:
        return float(c == t == 0)
    return stirling(c - 1, t - 1, d) + (c - 1 - d * t) * stirling(c - 1, t, d)


def test_seats_have_the_exact_chances():
    d, strength = 0.6, 0.8
    for c, base in ((2, 0.3), (5, 0.2), (7, 0.9)):
        weights = [stirling(c, t, d) * math.prod(strength + d * i for i in range(t)) * base**t for t in range(1, c + 1)]
        want = sum(t * w for t, w in enumerate(weights, 1)) / sum(weights)
        n = 4000  # rooms with one dish each
        tables, rooms = py.seat([c] * n, np.arange(n), [base] * n, n, d, strength, np.random.default_rng(2), 12, 6)
        assert abs(tables.mean() - want) < 0.05 and np.allclose(tables, rooms)


def test_customers_and_tables_stay_whole():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 300, 400)
    rooms = rng.integers(0, 9, 400)
    tables, per_room = py.seat(counts, rooms, np.full(400, 0.05), 9, 0.7, 1.0, rng, moves=7)
    assert ((tables <= counts) & (tables >= (counts > 0))).all()
    assert np.allclose(np.bincount(rooms, tables, 9), per_room)
    empty, none = py.seat([], [], [], 2, 0.5, 1.0, rng)
    assert len(empty) == 0 and list(none) == [0, 0]


def test_predictions_of_a_restaurant_sum_to_one():
    texts = pa.array(["a b a b c", "b a c a", "c c b"])
    layout = py.Layout(1)
    rows = dict(py.block_rows(layout, 0, texts, np.ones(3, bool)))
    shard = py._Shard(layout, pa.table({"key": [0], "origin": [0], "payload": [rows[0]]}))
    started = py._started(layout)(pa.table({"key": [0], "origin": [0], "payload": [rows[0]]}))
    table = started.append_column("told", pa.array([[{"at": py.N, "tot": 15.0}, {"at": py.V, "tot": 4.0}]]))
    answer = py._root(layout, 0)(table)
    totals = {py.V: 4.0} | dict(zip(answer["tot_at"][0].as_py(), answer["tot"][0].as_py()))
    chance = shard.answered({1: answer["payload"][0].as_py()}, totals)
    unseen = (py.ROOT[1] + py.ROOT[0] * totals[py.TABLES]) / 5 / (py.ROOT[1] + totals[py.CUSTOMERS])
    assert abs(chance.sum() + unseen - 1) < 1e-6
    tables, rooms, far, customers = shard.sample(chance, totals, np.zeros(len(shard.room_keys)), np.random.default_rng(1))
    for room in range(len(shard.room_keys)):
        pull = py.BELOW[1] + py.BELOW[0] * rooms[room]
        seen = [(shard.counts[i] - py.BELOW[0] * tables[i]) for i in range(len(shard.room)) if shard.room[i] == room]
        assert abs((sum(seen) + pull) / (py.BELOW[1] + customers[room]) - 1) < 1e-6


def test_blocks_change_no_counts_and_reruns_agree(make_docs, monkeypatch):
    rows = corpus(120)
    docs = make_docs(rows).repartition(2)
    first, again = run(docs), run(docs)
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    monkeypatch.setattr(py, "BLOCK_CHARS", 60)
    encode = py._encode(py.Layout(4), pa.int64())
    batch = make_docs(rows).select("doc_id", "text", (F.col("doc_id") < 0).alias("held")).toArrow()
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 1})()))
    blocks = [r for b in encode(iter(batch.to_batches(9))) for r in b.to_pylist() if r["ids"]]
    assert len(blocks) > 20 and [d for r in blocks for d in r["ids"]] == [r[0] for r in rows]


def test_odd_rows(make_docs, odd_rows):
    for layout in (py.Layout(1), py.Layout(5)):
        got = run(make_docs(odd_rows, extra=True), layout=layout)
        assert base_of(got) == brute_base(odd_rows)
        assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert run(make_docs([])) == []
    nothing = [(i, "only held out") for i in range(200) if is_held_out(i)]
    assert [(r.train_tokens, r.n_known, r.score, r.base_score) for r in run(make_docs(nothing))] == [(0, 0, 0.0, 0.0)] * len(nothing)


def test_layout_deals_out_frequent_words(make_docs):
    docs = make_docs([(i, "the " * 30 + f"word{i} other{i % 7}") for i in range(200)])
    layout = py.plan_layout(docs, shard_bytes=2000)
    assert layout.k > 5 and layout.large[py.word_key("the") >> 16][1] > 1
    assert py.plan_layout(docs).k == 1


@pytest.mark.parametrize("few", [1, 10**9])
def test_a_sweep_seats_every_customer_anew(few, monkeypatch):
    """Far from the start of few tables: one dish a room that all new customers ask for; side by side and one by one."""
    monkeypatch.setattr(py, "FEW", few)
    c, rooms, d, strength = 300, 60, 0.75, 1.0
    want = strength / d * (math.prod((strength + d + i) / (strength + i) for i in range(c)) - 1)
    drawn = []

    class Counted:
        rng = np.random.default_rng(4)

        def random(self, n=None):
            drawn.append(1 if n is None else n)
            return self.rng.random(n)

    tables, per_room = py.seat([c] * rooms, np.arange(rooms), [1.0] * rooms, rooms, d, strength, Counted(), 30, 30)
    assert sum(drawn) >= 60 * c * rooms
    assert abs(tables.mean() / want - 1) < 0.12  and np.allclose(tables, per_room)


class Drawn:
    """A generator that counts what it draws."""

    def __init__(self, seed):
        self.rng, self.n = np.random.default_rng(seed), 0

    def random(self, n=None):
        self.n += 1 if n is None else n
        return self.rng.random(n)

    def standard_gamma(self, shape):
        self.n += len(shape)
        return self.rng.standard_gamma(shape)


def test_dishes_that_share_a_room_have_the_exact_chances():
    d, strength, n = 0.6, 0.8, 4000
    dishes = [(1, 0.1), (3, 0.5), (6, 0.3), (2, 0.1)]
    weights, sums = 0.0, np.zeros(len(dishes))
    for ts in itertools.product(*(range(1, c + 1) for c, _ in dishes)):
        w = math.prod(stirling(c, t, d) * base**t for (c, base), t in zip(dishes, ts)) * math.prod(strength + d * i for i in range(sum(ts)))
        weights, sums = weights + w, sums + w * np.array(ts)
    counts, bases = (np.tile(x, n) for x in zip(*dishes))
    rng = Drawn(2)
    tables, rooms = py.seat(counts, np.repeat(np.arange(n), len(dishes)), bases, n, d, strength, rng, 12, 6)
    assert abs(tables.reshape(n, -1).mean(axis=0) - sums / weights).max() < 0.03
    assert np.allclose(tables.reshape(n, -1).sum(axis=1), rooms)
    assert rng.n == 18 * (n + 3 * n)  # one for a room and one for a dish, whatever its customers


@pytest.mark.parametrize("c", [256, 257])
def test_all_tables_of_a_dish_in_one_draw(c):
    """The same mean on both sides of the bound; up to it the draws do not grow with the customers."""
    rooms, d, strength, sweeps = 200, 0.75, 1.0, 60
    want = strength / d * (math.prod((strength + d + i) / (strength + i) for i in range(c)) - 1)
    rng = Drawn(4)
    tables, per_room = py.seat([c] * rooms, np.arange(rooms), [1.0] * rooms, rooms, d, strength, rng, sweeps // 2, sweeps // 2)
    assert abs(tables.mean() / want - 1) < 0.1 and np.allclose(tables, per_room)
    assert rng.n == 2 * rooms * sweeps if c == 256 else rng.n >= 2 * rooms * sweeps * c


def test_ways_are_the_weighted_counts():
    ways = py.log_ways(0.6, 9)
    assert all(math.isclose(math.exp(ways[c, t]), stirling(c, t, 0.6), rel_tol=1e-12) for c in range(1, 10) for t in range(1, c + 1))
    assert np.isneginf(ways[np.triu_indices(10, 1)]).all()
    rng = np.random.default_rng(6)
    # discount 0: a table more costs strength * base
    tables, _ = py.seat([4] * 3000, np.arange(3000), [0.5] * 3000, 3000, 0.0, 1.0, rng, 2, 4)
    chances = [stirling(4, t, 0.0) * 0.5**t for t in range(1, 5)]
    assert abs(tables.mean() - sum(t * w for t, w in enumerate(chances, 1)) / sum(chances)) < 0.05


def test_a_room_of_many_dishes_has_the_exact_mean():
    """Dishes whose bases sum to one: the room's tables hang on each other most."""
    d, rng, n = 0.75, np.random.default_rng(6), 60
    counts, ways, want = rng.integers(2, 40, (n, 20)), py.log_ways(0.75, 64), 0.0
    for room in counts:
        chances = np.zeros(1)  # logarithms, from one table each on
        for c in room:
            more = ways[c, 1 : c + 1] + np.arange(1, c + 1) * math.log(0.05)
            sums = np.full(len(chances) + c - 1, -np.inf)
            for i, x in enumerate(more):
                sums[i : i + len(chances)] = np.logaddexp(sums[i : i + len(chances)], chances + x)
            chances = sums
        tables = np.arange(len(chances)) + 20
        chances += np.cumsum(np.log(1 + d * np.arange(tables[-1])))[tables - 1]
        chances = np.exp(chances - chances.max())
        want += (chances * tables).sum() / chances.sum()
    tables, _ = py.seat(counts.ravel(), np.repeat(np.arange(n), 20), np.full(20 * n, 0.05), n, d, 1.0, rng, 60, 100)
    assert abs(tables.sum() / want - 1) < 0.025


def test_numbers_of_small_and_of_large_values():
    values = np.random.default_rng(5).integers(0, 50, 400)
    for scale in (1, 1 << 50, (1 << 57) - 1):
        of, distinct = py.numbered(values * scale)
        assert of.dtype == np.int32 and (distinct[of] == values * scale).all() and (np.diff(distinct) > 0).all()
    assert [len(a) for a in py.numbered(np.zeros(0, np.int64))] == [0, 0]


def test_packed_arrays_come_back():
    arrays = [np.arange(5), np.zeros(0, np.uint64), np.arange(70_000, dtype=np.uint64), np.linspace(-1, 1, 9).astype(np.float32), np.array([1 << 63], np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, py.unpack(py.pack(*arrays))))
    words = ["a", "é", "\U0001f600", "the"]
    key, payload = next(r for r in py.block_rows(py.Layout(1), 0, pa.array([" ".join(words)]), np.ones(1, bool)) if r[0] == 1)
    assert py.climbed(py.unpack(payload)[0]).tolist() == sorted([py.END] + [py.word_key(w) for w in words])
