import random
from collections import defaultdict

from millrace.llm import mixing


def water_fill(sizes, weights, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def check(rows, got):
    size, taken = defaultdict(int), defaultdict(int)
    src = defaultdict(list)
    for i, t, _, s in rows:
        size[s] += len((t or "").split())
        src[i].append(s)
    target = water_fill(size, mixing.WEIGHTS)
    assert len(got) == len(rows)
    for r in got:
        s = src[r.doc_id][0]
        taken[s] += r.taken
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-3
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
    for s in size:
        assert abs(taken[s] - target[s]) < 1


def corpus(n=600):
    rnd = random.Random(2)
    return [(i, "w " * rnd.randint(0, 40), "en", "hot" if i % 3 == 0 else f"s{rnd.randint(0, 9)}") for i in range(n)]


def test_targets_and_takes(make_docs):
    rows = corpus() + [(1000 + i, "a b", None, None) for i in range(3)] + [(2000, "", None, "hollow")]
    first = mixing.mix_documents(make_docs(rows)).collect()
    check(rows, first)
    again = mixing.mix_documents(make_docs(list(reversed(rows)))).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)


def test_positions_follow_the_schedule(make_docs):
    rows = [(i, "w " * 10, None, f"s{i % 3}") for i in range(900)]
    got = mixing.mix_documents(make_docs(rows)).collect()
    assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    early = sum(r.taken for r in got if r.position is not None and r.position < 0.5 and r.doc_id % 3 == 0)
    whole = sum(r.taken for r in got if r.doc_id % 3 == 0)
    assert 0.55 < early / whole < 0.7  # the integral of 1.5 - t over [0, 0.5] is 0.625


def test_odd_rows(make_docs, odd_rows):
    rows = [(i, t, None, s) for (i, t), s in zip(odd_rows, ["a", None, "b", "a", "a", "b", "b", "c", "c", None, "c", "a", "d"])]
    got = mixing.mix_documents(make_docs(rows, extra=True)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)


def test_empty(make_docs):
    assert mixing.mix_documents(make_docs([])).collect() == []


def test_corpus_repeats_documents(make_docs):
    docs = make_docs(corpus())
    out = mixing.mix_corpus(docs)
    assert out.columns == docs.columns
    takes = {r.doc_id: (r.size, r.taken) for r in mixing.mix_documents(docs).collect()}
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    for i, (size, taken) in takes.items():
        assert seen[i] == (-(-taken // size) if size else 1)


def test_every_occurrence_has_its_own_position(make_docs):
    docs = make_docs([(i, "w " * 10, None, f"s{i % 3}") for i in range(300)])
    want = []
    for r in mixing.mix_documents(docs).collect():
        opening, closing = mixing.RAMPS[r["rank"] % 3]
        for k in range(-(-r.taken // r.size)):
            share = (r["at"] + k * r.source_size) / r.target
            t = 2 * share / (opening + (opening**2 + 2 * (closing - opening) * share) ** 0.5)
            want.append((t, r["rank"], r["at"], k, r.doc_id))
    got = [r.doc_id for r in mixing.mix_corpus(docs).collect()]
    assert got == [w[-1] for w in sorted(want)]
    last_first = max(i for i, w in enumerate(sorted(want)) if w[3] == 0)
    assert sum(w[3] == 1 for w in sorted(want)[:last_first]) > 40  # second passes start before the last first one


def test_rows_with_one_id_have_their_own_verdicts(make_docs):
    rnd = random.Random(5)
    rows = [(i // 4, f"t{i} " * rnd.randint(1, 30), None, "big" if i % 4 else f"s{i % 3}") for i in range(400)]
    rows += [(None, f"n{i} w", None, "big") for i in range(40)] + [(7, None, None, "big"), (7, "", None, "big")]
    docs = make_docs(rows)
    size, words = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    got = mixing.mix_corpus(docs).collect()
    for r in got:
        words[r.source] += len((r.text or "").split())
    for s, want in water_fill(size, mixing.WEIGHTS).items():
        assert want - 1 < words[s] < want + 30, s  # a started pass over one document counts whole
    assert sum(r.text == "" for r in got) == 1 and sum(r.text is None for r in got) == 1
    assert [tuple(r) for r in mixing.mix_corpus(make_docs(list(reversed(rows)))).collect()] == [tuple(r) for r in got]


def test_corpus_of_odd_and_no_rows(make_docs, odd_rows):
    assert mixing.mix_corpus(make_docs([])).collect() == []
    rows = [(i, t, None, "a") for i, t in odd_rows]
    assert mixing.mix_corpus(make_docs(rows, extra=True)).count() >= len(rows)
