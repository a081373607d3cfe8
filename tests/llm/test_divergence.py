"""Divergences against sums over all terms and pairs in plain Python."""

import random
from collections import Counter

import pytest
import regex

from millrace.llm import divergence

TERM = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(rows, least=10, top=10):
    docs = [((r[2] if len(r) > 2 else None) or "", (r[3] if len(r) > 3 else None) or "", r[1] or "") for r in rows]
    counts, having = {}, {}
    for lang, source, text in docs:
        found = Counter(terms_of(text))
        counts.setdefault((lang, source), Counter()).update(found)
        having.setdefault(lang, Counter()).update(found.keys())
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in having.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in counts:
        words = kept[lang]
        shares = {}
        for other in [s for g, s in counts if g == lang] + [None]:
            c = counts[lang, other] if other is not None else sum((c for (g, _), c in counts.items() if g == lang), Counter())
            total = sum(c[t] for t in words)
            shares[other] = {t: share(c[t], total, len(words)) for t in words}
        mine = shares[source]
        pairs = [(o, sum(f(mine[t], q[t]) for t in words)) for o, q in shares.items() if o not in (None, source)]
        own = [(t, f(mine[t], shares[None][t])) for t in words if counts[lang, source][t] and mine[t] > shares[None][t]]
        for part, items, most in (("pair", pairs, None), ("term", own, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def run(docs, **options):
    return sorted(tuple(r) for r in divergence.source_divergence(docs, **options).collect())


def some(n=400):
    rnd = random.Random(3)
    words = {"en": "the River STONE light ünder green".split() + [f"w{c}" for c in "abcdefghijk"], "de": "der die Fluß stein".split(), None: ["x-y", "z1q"]}
    out = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "de", None])
        out.append((i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(0, 12))), lang, rnd.choice(["s0", "s0", "s1", "s2", "", None, "ß"])))
    return out


@pytest.mark.parametrize("least,top", [(10, 10), (1, 3), (60, 10), (10_000, 10)])
def test_equals_plain_sums(make_docs, least, top):
    assert run(make_docs(some()), least_docs=least, top=top) == brute(some(), least, top)


def test_blocks_and_merges_change_nothing(make_docs, monkeypatch):
    want = brute(some())
    for chars, rows in ((1, 1), (50, 20), (300, 5)):
        monkeypatch.setattr(divergence, "BLOCK_CHARS", chars)
        monkeypatch.setattr(divergence, "MERGE_ROWS", rows)
        batches = [b for b in make_docs(some()).select("lang", "source", "text").fillna("").toArrow().to_batches(7)]
        total = Counter()
        for b in divergence._count_terms(iter(batches)):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"]] += r["n"]
        plain = Counter()
        for _, text, lang, source in some():
            for t in terms_of(text):
                plain[lang or "", source or "", t] += 1
        assert total == plain
    assert run(make_docs(some()).repartition(9)) == want


def test_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (20, "A\x00B a\x7fb É_é", "en", "s"), (21, "solo", "fr", "only"), (22, None, "fr", "none")]
    for least in (1, 2):
        assert run(make_docs(rows, extra=True), least_docs=least) == brute(rows, least)
    assert run(make_docs([])) == []
