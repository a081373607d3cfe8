"""Set containment and dictionary search against all pairs in plain Python."""

import random

from millrace.operators import containment, dictionary
from millrace.session import ship_package


def maps(rnd, n, most):
    return [None if rnd.random() < 0.08 else {k: rnd.choice(["1", "2", None]) for k in rnd.sample(["uri", "intentName", "a", "b"], rnd.randint(0, most))} for _ in range(n)]


def within(a, b):
    return all(k in b and b[k] == v for k, v in a.items())


def test_rules_equal_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("tu"), m) for i, m in enumerate(maps(rnd, 80, 4))]
    rules = [("u" if m else "t", i, f"r{i}", m) for i, m in enumerate(maps(rnd, 14, 2))]
    got = containment.match_sets(
        spark.createDataFrame(rows, "id int, kind string, props map<string,string>"), spark.createDataFrame(rules, "kind string, ord int, rule string, wanted map<string,string>"),
        "props", "wanted", "ord", ["id"], ["kind"],
    ).collect()
    want = {}
    for i, kind, props in rows:
        mine = [(o, r, w) for k, o, r, w in rules if k == kind and w is not None]
        full = [(o, r) for o, r, w in mine if not w or (props is not None and within(w, props))]
        half = [r for o, r, w in mine if w and props is not None and not within(w, props) and any(k in props and props[k] == v for k, v in w.items())]
        outcome = "ambiguous" if len(full) > 1 else "full" if full else "half" if half else "none"
        want[i] = (min(full)[1] if full else None, outcome, len(full), len(half))
    assert {r.id: (r.rule, r.outcome, r.n_full, r.n_half) for r in got} == want
    assert {"ambiguous", "full", "half"} <= {w[1] for w in want.values()}


def test_events_equal_all_pairs(spark):
    rnd = random.Random(6)
    handlers = [(rnd.randrange(4), f"h{i}", rnd.choice("cde"), m) for i, m in enumerate(maps(rnd, 120, 3))]
    offered = [(rnd.randrange(4), i, rnd.choice("cde"), m) for i, m in enumerate(maps(rnd, 30, 3))]
    got = containment.match_events(
        spark.createDataFrame(handlers, "c int, handler string, call string, args map<string,string>"), spark.createDataFrame(offered, "c int, pos int, call string, args map<string,string>"), "c"
    ).collect()
    want = {}
    for case, h, call, args in handlers:
        same = [(p, a) for c, p, k, a in offered if (c, k) == (case, call)]
        ranks, fits, half = [], 0, 0
        for pos, other in same:
            rank = None
            if args is not None and other is not None:
                linked = any(args.get(k) and args[k] == other.get(k) for k in containment.LINKS)
                rank = 0 if args == other else 1 if within(args, other) or within(other, args) or linked else None
                fits += rank is not None
                half += rank is None and any(k in other and other[k] == v for k, v in args.items())
            if rank is None and len(same) == 1:
                rank = 2
            if rank is not None:
                ranks.append((rank, pos))
        want[h] = (*(min(ranks) if ranks else (None, None)), fits, half)
    assert {r.handler: (r.rule, r.candidate, r.n_fits, r.n_half) for r in got} == want
    assert {w[0] for w in want.values()} == {None, 0, 1, 2}


def test_dictionary_equals_every_place(spark, monkeypatch):
    ship_package(spark)
    rnd = random.Random(8)
    texts = [(i, "".join(rnd.choice("abü😀 ") for _ in range(rnd.randint(0, 120)))) for i in range(60)] + [(90, None), (91, ""), (92, "a" * 3000), (92, "ab")]
    patterns = [("q", "ab"), ("q", "b"), ("u", "ab"), ("q", "ab"), ("s", "aü"), ("s", "😀 a"), ("s", None), ("s", ""), (None, "aaa"), ("q", "absent")]
    df = spark.createDataFrame(texts, "doc long, t string").repartition(3)
    told = spark.createDataFrame(patterns, "kind string, pattern string")
    want = sorted((i, k or "", p, s, s + len(p)) for i, t in texts for k, p in {x for x in patterns if x[1]} for s in range(len(t or "")) if (t or "").startswith(p, s))
    for bounds in ({}, {"most": 2}, {"chars": 7}):
        assert sorted(tuple(r) for r in dictionary.dictionary_hits(df, "doc", "t", told, **bounds).collect()) == want
    assert dictionary.dictionary_hits(df, "doc", "t", told.limit(0)).collect() == []
    first = {(r.id, r.kind, r.pattern): (r.first_at, r.hits) for r in dictionary.leaks(df, "doc", "t", told).collect()}
    assert first[92, "", "aaa"] == (0, 2998)


def test_many_patterns(spark):
    ship_package(spark)
    patterns = spark.range(50_000).selectExpr("'user' as kind", "concat('name', id, '#') as pattern")
    df = spark.createDataFrame([(i, f"by name{i * 5}# and name{i}x") for i in range(2000)], "doc long, t string")
    hits = dictionary.dictionary_hits(df, "doc", "t", patterns)
    assert sorted((r.id, r.pattern, r.start) for r in hits.collect()) == [(i, f"name{i * 5}#", 3) for i in range(2000)]
