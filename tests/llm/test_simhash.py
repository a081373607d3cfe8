import random
import re

import numpy as np
import xxhash

from millrace.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def texts(n, seed=3):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(5, 200))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 2))):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append((i, " ".join(t)))
    return out


def got(docs):
    return sorted((tuple(r) for r in simhash.near_duplicate_classes(docs).collect()), key=str)


def test_matches_brute_force(make_docs):
    rows = texts(160)
    assert got(make_docs(rows)) == brute(rows)


def test_odd_rows_and_clashing_columns(make_docs, odd_rows):
    assert got(make_docs(odd_rows, extra=True)) == brute(odd_rows)


def test_empty(make_docs):
    assert got(make_docs([])) == []


def test_chain_of_steps_is_one_component(spark):
    prints = [0] + [(1 << (3 * k)) - 1 for k in range(1, 20)] + [0xFFFF << 48 | 1 << 5]
    links = simhash.fingerprint_links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long"))
    stars = {r.u: r.v for r in simhash.connected_components(links).collect()}
    assert len({stars.get(p, p) for p in prints[:20]}) == 1
    assert (prints[20] - (1 << 64)) not in stars


def test_a_large_posting(spark):
    centre = 0x123456789ABCDEF0
    prints = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(60)})
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert links.count() < 60 * len(prints)
    stars = simhash.connected_components(links)
    assert stars.count() == len(prints) - 1 and stars.select("v").distinct().count() == 1


def test_one_of_each_class_stays(make_docs, odd_rows):
    left = simhash.drop_near_duplicates(make_docs(odd_rows, extra=True)).collect()
    ids = [r.doc_id for r in left]
    assert ids.count(6) == 1 and ids.count(None) == 2 and 1 in ids and 2 not in ids and 7 not in ids


def test_whole_long_text_counts():
    a = "alpha beta gamma " * 200000
    assert simhash.fingerprint(a) == simhash.fingerprint(a.upper())
    assert simhash.fingerprint("x y z " * 10) == brute_print("x y z " * 10)


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute_kept(rows):
    """The (doc_id, text) that stay, from all pairs."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if group[i] != group[j] and (not both or len(sets[i] & sets[j]) / both >= 0.8):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, t), g in zip(rows, group):
        least[g] = min(least.get(g, (d, t)), (d, t))
    return sorted(least.values())


def near_copies(bases=40, seed=5):
    """Texts with copies in which one to four words of 60 differ, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 500)) for _ in range(60)]
        out.append(list(base))
        for k in (1, 1, 2, 3, 4):
            copy = list(base)
            for at in rnd.sample(range(60), k):
                copy[at] = "new%d" % rnd.randint(0, 10**6)
            out.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_near_copies_of_four_fifths_go(make_docs):
    rows = near_copies() + [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (904, "one three")]
    want = [d for d, _ in brute_kept([(d, t or "") for d, t in rows])]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(make_docs(rows, extra=True)).collect()) == want
    assert len(rows) - len(want) > 80


def test_similarity_at_the_bound():
    a = list(range(9))
    sets = [simhash.np.array(x, simhash.np.uint64) for x in (a, a[:8] + [50], a[:7] + [60, 61], a)]
    assert sorted(simhash.similar_links(sets)) == [(0, 1), (0, 3)]  # 8 of 10, 7 of 11


def test_tally_counts_bytes_in_place_and_never_loses_a_near_pair():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 1 << 63, 400, np.uint64)
    flips = [sum(1 << int(k) for k in rnd.choice(64, i % 6, replace=False)) for i in range(400)]
    b = a ^ np.array(flips, np.uint64)
    want = [sum(x == y for x, y in zip(int(p).to_bytes(8, "little"), int(q).to_bytes(8, "little"))) for p, q in zip(a, b)]
    assert simhash.tally(a, b).tolist() == want
    assert simhash.near_pairs(a, b).tolist() == [bin(f).count("1") <= simhash.MAX_DIFF for f in flips]


def drifting_copies(n=160, seed=8):
    """One large group: copies of copies, each with a few more words changed, so that the ends are far apart."""
    rnd = random.Random(seed)
    texts = [["w%d" % i for i in range(60)]]
    while len(texts) < n:
        copy = list(rnd.choice(texts))
        for at in rnd.sample(range(60), rnd.choice((1, 1, 1, 2))):
            copy[at] = "new%d" % rnd.randint(0, 10**6)
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_buckets_too_large_for_a_task_lose_no_link(make_docs):
    rows = drifting_copies()
    docs = make_docs(rows)
    index = simhash.pin(simhash.candidate_index(docs))
    for most in (150, 3000):  # three sets, and about a third of them
        stars = simhash.connected_components(simhash.similarity_links(docs, index, most))
        root = {r.u: r.v for r in stars.collect()}
        classes = {}
        for r in index.select("doc_id", "sid").collect():
            classes.setdefault(root.get(r.sid, r.sid), []).append(r.doc_id)
        assert sorted(min(x) for x in classes.values()) == [d for d, _ in brute_kept(rows)]


def test_cells_hold_every_pair_that_the_leader_does_not_settle(spark, make_docs):
    rows = drifting_copies(60)
    sets = {i: simhash.shingle_set(list(simhash.shingle_hashes(t, 5))) for i, t in rows}
    frame = spark.createDataFrame([(i, s.tobytes(), s.size) for i, s in sets.items()], "sid long, members binary, n long")
    links, cells = simhash._split_buckets(frame.selectExpr("7L AS bucket", "sid", "n"), frame, 500)
    linked = {(r.u, r.v) for r in links.collect()}
    near = {0} | {v for _, v in linked}
    together, weight = set(), {}
    for r in cells.groupBy("bucket").agg({"sid": "collect_set"}).collect():
        held = sorted(r[1])
        weight[r[0]] = sum(sets[i].size for i in held)
        together |= {(a, b) for a in held for b in held if a < b}
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8
    want = {(a, b) for a in sets for b in sets if a < b and like(a, b) and not {a, b} <= near}
    assert linked == {(0, b) for b in sets if b and like(0, b)} and want and want <= together
    assert len(weight) > 3 and max(weight.values()) < sum(s.size for s in sets.values()) * 0.8


def test_keys_with_many_postings_are_passed_on_as_they_come():
    key = np.repeat(np.array([-5, 1, 2, 9]), [2, 50, 1, 30])
    sid = np.arange(key.size)
    parts = [simhash.pa.RecordBatch.from_arrays([simhash.pa.array(key[i : i + 7]), simhash.pa.array(sid[i : i + 7])], ["key", "sid"]) for i in range(0, key.size, 7)]
    found = {}
    for b in simhash._shared_buckets(iter(parts), 20):
        for bucket, s in zip(*(c.to_pylist() for c in b.columns)):
            found.setdefault(bucket, []).append(s)
    assert sorted(map(sorted, found.values())) == [[0, 1], list(range(2, 52)), list(range(53, 83))]
    assert sum(map(len, found.values())) == 82
