import itertools
import random

import numpy as np

from millrace.llm import langid

WORDS = {
    "en": "the of and that river stone light went over house green water thing".split(),
    "de": "der die und nicht fluss stein licht ging haus wasser über grün dinge".split(),
    "fr": "le la et pas rivière pierre lumière alla maison eau sur vert chose".split(),
}


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[g]) for _ in range(rnd.randint(5, 60))), g) for i in range(n) for g in [rnd.choice(list(WORDS))]]


def test_held_out_accuracy(make_docs, odd_rows):
    rows = corpus() + [(900 + i, t) for i, (_, t) in enumerate(odd_rows)]
    got = {r.doc_id: r for r in langid.language_report(make_docs(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    import zlib

    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].held_out for r in held)
    assert sum(got[i].lang_pred == g for i, _, g in held) >= 0.98 * len(held)
    for i, t in enumerate(x[1] for x in odd_rows):
        r = got[900 + i]
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= r.score <= 1


def test_code_switched_words_are_labelled_one_by_one():
    model = langid.train([(g, langid.words_of(t)) for _, t, g in corpus()])
    words = WORDS["en"][:8] + WORDS["fr"][:8]
    p = langid.forward_backward(model.emissions(words), np.array([16]), model.moves, model.start)
    told = [model.labels[k] for k in p.argmax(axis=1)]
    assert told == ["en"] * 8 + ["fr"] * 8
    assert model.moves[0, 0] > model.moves[0, 1]


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(0)
    lengths, k = np.array([3, 1, 4]), 3
    scores, moves, start = rnd.normal(size=(8, k)), rnd.normal(size=(k, k)), rnd.normal(size=k)
    got, at = langid.forward_backward(scores, lengths, moves, start), 0
    for n in lengths:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            s = start[path[0]] + sum(scores[at + t, p] for t, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            for t, p in enumerate(path):
                want[t, p] += np.exp(s)
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_no_labels_and_no_rows(make_docs):
    assert langid.language_report(make_docs([])).collect() == []
    assert [r.lang_pred for r in langid.language_report(make_docs([(1, "words here")])).collect()] == ["und"]


def test_every_label_and_long_texts_are_learned(make_docs):
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:02}" for k in range(70)]
    words = {g: ["".join(rnd.choice(letters) for _ in range(6)) for _ in range(5)] for g in names}
    rows = [(i, " ".join(rnd.choice(words[g]) for _ in range(20)), g) for i, g in enumerate(names * 8)]
    long = [(1000 + i, "zo quux vlam " * 3000, "long") for i in range(8)]
    got = langid.training_sample(make_docs(rows + long))
    assert {g for g, _ in got} == {*names, "long"}
    cut = next(w for g, w in got if g == "long")
    assert set(cut) == {"zo", "quux", "vlam"} and 1000 < len(cut) <= langid.SAMPLE_CHARS
    model = langid.train(got, sequences=600, rounds=20)
    mass = model.posterior_mass([t.split() for _, t, _ in rows[:70]] + [["vlam", "quux", "zo"]])
    told = [model.labels[k] for k in mass.argmax(axis=1)]
    assert sum(a == b for a, b in zip(told, [*names, "long"])) >= 68


def test_too_many_labels_are_an_error(make_docs):
    import pytest

    with pytest.raises(ValueError, match="languages"):
        langid.training_sample(make_docs([(i, "one word", f"l{i}") for i in range(langid.LABELS + 1)]))


def test_a_long_word_is_judged_whole():
    model = langid.train([(g, langid.words_of(t)) for _, t, g in corpus()])
    en, de = "the" * 7, "wasserübergründinge" * 30
    words = langid.words_of(en + de + en)
    assert "".join(words) == en + de + en and max(map(len, words)) <= langid.PIECE
    assert model.labels[model.posterior_mass([words])[0].argmax()] == "de"
    whose, bucket = langid.features(["a" * 60 + "b" * 60, "a" * 60 + "c" + "b" * 59], frozenset())
    assert set(bucket[whose == 0]) != set(bucket[whose == 1])


def test_features_match_brute_force():
    """Equal names give equal buckets, and each word has as many as it has affixes and n-grams."""
    words, lexicon = ["a", "ab", "the", "thé", "then", "weather", "straße", "日本"], frozenset(["the", "ab"])
    whose, bucket = langid.features(words, lexicon)
    seen = {}
    for i, w in enumerate(words):
        padded = f"^{w}$"
        names = [("p", padded[:k]) for k in (2, 3, 4)] + [("s", padded[-k:]) for k in (2, 3, 4)]
        names += [("g", padded[j : j + k]) for k in (1, 2, 3) for j in range(len(padded) - k + 1)]
        names += [("l", w), ("l", "")] * (w in lexicon)
        got = sorted(bucket[whose == i])
        assert len(got) == len(names)
        for name in names:
            alone = seen.setdefault(name, set())
            alone.add(i)
        seen[i] = got
    shares = lambda a, b: len(set(seen[a]) & set(seen[b]))
    same = lambda a, b: sum(a in v and b in v for k, v in seen.items() if isinstance(v, set))
    for a in range(len(words)):
        for b in range(a):
            assert shares(a, b) == same(a, b)


def test_report_matches_brute_force(make_docs):
    """The whole query against path enumeration: labels and shares of short texts, one by one."""
    rows = [(i, " ".join(t.split()[:5]), g) for i, t, g in corpus(60)] + [(900, None), (901, " 1 2 "), (902, "the der la")]
    docs = make_docs(rows, extra=True)
    model = langid.train(langid.training_sample(docs.where(~langid.held_out(docs["doc_id"]))))
    k = len(model.labels)
    for r in langid.language_report(docs).collect():
        words = langid.words_of(dict((x[0], x[1]) for x in rows)[r.doc_id] or "")
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        emit, mass, total = model.emissions(words), np.zeros(k), 0.0
        for path in itertools.product(range(k), repeat=len(words)):
            p = np.exp(model.start[path[0]] + sum(emit[t, j] for t, j in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for j in path:
                mass[j] += p
        assert r.lang_pred == model.labels[int(mass.argmax())] and abs(r.score - mass.max() / total / len(words)) < 1e-5
