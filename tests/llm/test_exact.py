import hashlib
import random

from millrace.llm import exact


def brute(rows):
    norm = [(t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for _, t in rows]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for n, same in groups.items():
        best = min(same, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[best][0], len(same), i == best, hashlib.sha256(n.encode()).hexdigest()) for i in same]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(n=300):
    rnd = random.Random(5)
    return [(i, rnd.choice("abcdefgh") * rnd.randint(0, 3) + " " * rnd.randint(0, 2) + rnd.choice("xyz ")) for i in range(n)]


def test_matches_brute_force(make_docs):
    assert got(exact.exact_duplicate_groups(make_docs(some()))) == brute(some())


def test_odd_rows(make_docs, odd_rows):
    assert got(exact.exact_duplicate_groups(make_docs(odd_rows, extra=True))) == brute(odd_rows)


def test_empty(make_docs):
    assert got(exact.exact_duplicate_groups(make_docs([]))) == []


def test_collisions_do_not_merge(make_docs):
    assert got(exact.exact_duplicate_groups(make_docs(some(40)), hash_bits=3)) == brute(some(40))


def test_parts_combine_in_any_cut():
    data = random.Random(1).randbytes(3 * exact.CHUNK + 77)
    whole = exact.fingerprint(data)
    for cut in (1, exact.CHUNK - 1, exact.CHUNK, 2 * exact.CHUNK + 5):
        a, b = data[:cut], data[cut:]
        ha, hb = exact.fingerprint(a), exact.fingerprint(b)
        pair = exact.combine((ha >> 31, ha & 0x7FFFFFFF), (hb >> 31, hb & 0x7FFFFFFF), len(b))
        assert pair[0] << 31 | pair[1] == whole


def test_one_of_each_group_stays(make_docs, odd_rows):
    left = exact.drop_exact_duplicates(make_docs(odd_rows, extra=True))
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [3, 4, 5, 6, 7, 8, 9] and ids.count(None) == 1
    assert left.columns == make_docs(odd_rows, extra=True).columns


def test_huge_documents_are_hashed_in_chunks(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 4096)
    monkeypatch.setattr(exact, "_TABLES", [])
    rnd = random.Random(6)
    long = "".join(rnd.choice("abc \n") for _ in range(30_000))
    rows = [*odd_rows, (20, long), (21, long.replace(" ", "")), (22, long[:-9] + "q"), (20, long), (None, long), (23, " " * 300)]
    for huge in (1, 200, 1 << 30):
        assert got(exact.exact_duplicate_groups(make_docs(rows, extra=True), huge=huge)) == brute(rows)
    assert got(exact.exact_duplicate_groups(make_docs(rows), hash_bits=2, huge=200)) == brute(rows)


def test_rows_that_repeat_an_id_leave_one(make_docs):
    rows = [(1, "a b"), (1, "ab"), (1, "a    b"), (2, "ab"), (3, "x"), (3, "x"), (4, None), (4, ""), (3, "y"), (5, "p q"), (5, "pq "), (None, "z  z"), (None, "zz")]
    assert got(exact.exact_duplicate_groups(make_docs(rows))) == brute(rows)
    left = exact.drop_exact_duplicates(make_docs(rows)).collect()
    told = [(r.doc_id, r.text) for r in left]
    assert len(told) == 6 and {(1, "a    b"), (3, "x"), (3, "y"), (None, "z  z")} <= set(told)
    assert [d for d, t in told if d == 4] == [4] and [len(t) for d, t in told if d == 5] == [3]
    assert exact.drop_exact_duplicates(make_docs([])).collect() == []


def test_the_longest_of_one_id_stays(make_docs):
    rows = [(i, text) for i in range(6) for text in (f"k{i} w", f"k{i}     w")]
    assert sorted(len(r.text) for r in exact.drop_exact_duplicates(make_docs(rows)).collect()) == [8] * 6
    kept = [r for r in exact.exact_duplicate_groups(make_docs([(1, "a b"), (1, "a    b"), (2, "ab")])).collect() if r.kept]
    assert [r.doc_id for r in kept] == [1]
