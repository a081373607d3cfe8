import math
import random
import zlib

import numpy as np
import zstandard

from millrace.llm import toxicity

BAD = ["idiotic", "wretched", "vermin", "scoundrel"]


def corpus(n=700):
    rnd = random.Random(4)
    syll = ["tion", "er", "an", "the", "in", "re", "on", "st", "al", "ou"]
    out = []
    for i in range(n):
        words = ["".join(rnd.choice(syll) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 80))]
        y = int(rnd.random() < 0.25)
        for _ in range(rnd.randint(2, 5) * y):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        out.append((i, " ".join(words), y))
    return out


def report(spark, make_docs, rows, extra=()):
    docs = make_docs([r[:2] for r in rows] + list(extra), extra=True)
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return toxicity.toxicity_report(docs, labels).collect()


def test_held_out_accuracy(spark, make_docs, odd_rows):
    rows = corpus()
    odd = [(10_000 + i, t) for i, (_, t) in enumerate(odd_rows)]
    got = {r.doc_id: r for r in report(spark, make_docs, rows, odd)}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(got[r[0]].held_out for r in held)
    toxic, clean = [r for r in held if r[2]], [r for r in held if not r[2]]
    assert sum(got[r[0]].predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(got[r[0]].predicted for r in clean) <= 0.05 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_the_label_of_a_held_out_row_is_not_learned(spark, make_docs):
    rows = corpus(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    turned = [(i, t, 1 - y if held(i) else y) for i, t, y in rows]
    a, b = (sorted((r.doc_id, r.score) for r in report(spark, make_docs, x)) for x in (rows, turned))
    assert a == b


def test_no_labels_and_no_rows(spark, make_docs):
    assert [r.score for r in report(spark, make_docs, [], [(1, "text")])] == [0.0]
    assert report(spark, make_docs, []) == []


def test_scores_match_plain_zstandard(spark, make_docs, odd_rows):
    """The whole query against compression by hand: margins word by word, counts, and the logistic curve."""
    rows = corpus(400)
    docs = make_docs([r[:2] for r in rows] + [(10_000 + i, t) for i, (_, t) in enumerate(odd_rows)])
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.training_sample(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    options = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def length(data, dictionary):
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=options).compress(data))

    for r in docs.collect()[:120] + docs.collect()[-13:]:
        words = toxicity.words_of(r.text or "")
        margin = {w: length(toxicity.window(w), model.ordinary) - length(toxicity.window(w), model.toxic) for w in set(words)}
        hits = [sum(margin[w] >= m for w in words) for m in toxicity.MARGINS]
        x = [math.log1p(h) for h in hits] + [math.log1p(100 * h / max(1, len(words))) for h in hits] + [math.log1p(len(words)) / 5, 1.0]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-float(np.dot(x, model.curve))))) < 1e-9


def test_too_little_to_learn_scores_zero(spark, make_docs):
    assert {r.score for r in report(spark, make_docs, corpus(40))} == {0.0}


def test_long_rows_are_learned(spark, make_docs):
    rnd = random.Random(12)
    plain = ["".join(rnd.choice("abcdeflmnorst") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(160):
        words = [rnd.choice(plain) for _ in range(15_000)]
        if i % 3 == 0:
            for at in range(0, len(words), 40):
                words[at] = rnd.choice(BAD)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    assert min(len(r[1]) for r in rows) > 80_000
    got = {r.doc_id: r for r in report(spark, make_docs, rows)}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 30 and all(got[r[0]].predicted == r[2] for r in held)
