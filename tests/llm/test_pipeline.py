import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_exact import brute as brute_exact
from test_simhash import brute_kept

from millrace.llm import bpe, langid, mixing

WORDS = {
    "en": "the of and that river stone light went over house green water".split(),
    "de": "der die und nicht fluss stein licht ging haus wasser über grün".split(),
}


def corpus(n=240):
    rnd = random.Random(9)
    out = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "de"])
        roll = rnd.random()
        if i > 10 and roll < 0.15:
            out.append((i, (out[rnd.randrange(10)][1] or "") + rnd.choice(["", " ", "\n"]), lang, f"s{i % 4}"))
        elif roll < 0.25:
            out.append((i, rnd.choice([None, "", "123 456", "?! 77"]), lang, f"s{i % 4}"))
        elif roll < 0.45 and i > 30:  # some words of an earlier text changed: similarities on both sides of the bound
            words = rnd.choice([t for _, t, *_ in out[:30] if t and len(t.split()) >= 60]).split()
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS[lang])
            out.append((i, " ".join(words), lang, f"s{i % 4}"))
        else:
            out.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(60, 90))), lang, f"s{i % 4}"))
    return out


def test_stages_against_plain_python(spark, make_docs, tmp_path):
    rows = corpus()
    docs = make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    given = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        pairs = [g[:2] for g in given]
        if k == 0:
            assert sorted(got) == sorted(g for g in given if g[1] and langid.words_of(g[1]))
        elif k == 1:
            keep = {d for d, kept, *_ in brute_exact(pairs) if d == kept}
            assert sorted(got) == sorted(g for g in given if g[0] in keep)
        elif k == 2:
            keep = {d for d, _ in brute_kept(pairs)}
            assert sorted(got) == sorted(g for g in given if g[0] in keep) and len(keep) < len(given) - 10
        else:
            takes = {r.doc_id: (r.size, r.taken) for r in mixing.mix_documents(make_docs(given)).collect()}
            assert Counter(g[0] for g in got) == Counter({d: -(-t // s) for d, (s, t) in takes.items() if t})
        given = got
    final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    ranks = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((g[0], library.encode_ordinary(g[1])) for g in given)
    assert sorted((r.doc_id, list(r.ids)) for r in final) == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in whole) == want


def test_no_rows_and_odd_rows_pass_every_stage(spark, make_docs, odd_rows, tmp_path):
    for name, rows in (("none", []), ("odd", [(i, t, "en", None) for i, t in odd_rows])):
        folder = tmp_path / name
        make_docs([*rows, *([(1000 + i, t, lang, s) for i, t, lang, s in corpus(60)] if rows else [])]).write.parquet(str(folder / "documents.parquet"))
        assert (corpus_pipeline.run(spark, str(folder)).count() > 0) == bool(rows)
