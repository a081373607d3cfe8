import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def strange(seed, n):
    rnd = random.Random(seed)
    bag = ["the", "tion", " ", "  ", "\n", "aaaa", "é", "ß", "日本", "'s", "123", "...", "\t", "x" * 30, "🙂", "'LL", "　", "-", "Ωmega", "\x1c", "<|endoftext|>"]
    return ["".join(rnd.choice(bag) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_agrees_with_the_library(vocabulary, library):
    own = bpe.Encoder(vocabulary, PATTERN)
    for text in strange(1, 600):
        assert own.encode(text) == library.encode_ordinary(text)
        assert vocabulary.decode(own.encode(text)).decode() == text


def test_long_texts_are_cut_safely(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    own = bpe.Encoder(vocabulary, PATTERN)
    for text in [" ".join(strange(2, 40)), "word " * 500, "a" * 3000, " " * 700 + "x"]:
        assert own.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(vocabulary):
    rnd = random.Random(4)
    for _ in range(60):
        table = bpe.PrefixTable(vocabulary, b"".join(rnd.choice([b"in", b"ter", b"a", b"\xc3\xa9", b"ing"]) for _ in range(rnd.randint(0, 400))))
        table.append(b"nation")
        start = rnd.randint(0, len(table.data))
        stop = rnd.randint(start, min(len(table.data), start + 5))
        work = table.replace(start, stop, rnd.choice([b"", b"st", b"q", b"ation"]))
        assert table.ids() == bpe.PrefixTable(vocabulary, table.data).ids()
        assert work <= len(table.data)


def test_an_edit_near_the_front_is_local(vocabulary):
    table = bpe.PrefixTable(vocabulary, b"international" * 400)
    assert table.replace(5, 6, b"x") < 3 * vocabulary.longest


def test_rows(make_docs, odd_rows, library):
    got = bpe.round_trip(make_docs(odd_rows, extra=True), PATH, PATTERN).collect()
    want = []
    for i, text in odd_rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(make_docs):
    assert bpe.round_trip(make_docs([]), PATH, PATTERN).collect() == []
