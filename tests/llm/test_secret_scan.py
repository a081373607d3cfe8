import hashlib
import re

from millrace.llm import secret_scan as s


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(a, e, k) for a, _, e, k in sorted(out)]


KEY, SECRET = "AKIA" + "Q7XW" * 4, "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEK3Y"
TEXTS = [
    None, "", "nothing here", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "PassWord:hunter2x and passwd = abc", "api_key='A1B2C3D4' apikey: zzzzzz",
    "secret=a.token=abcdefgh", f"é {KEY} end", "AKIASHORT", "tokeN=abcdef toKen=abcdef", "deadbeef" * 3, "deadbeef" * 2 + "z", "ſecret=abcdefg " * 3,
]


def test_base_spans_match_brute_force(make_docs):
    got = s.secret_report(make_docs(list(enumerate(TEXTS)), extra=True)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute(TEXTS[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in want) for x in ("assign", "access", "hex"))
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def linked(text):
    return [k for *_, k in s.linked_spans(text, s.base_spans(text))]


def test_weak_parts_need_each_other():
    assert linked(f"key {SECRET} alone") == []
    assert linked("client_id: backup-user") == []
    assert linked("see https://example.com/page") == []
    assert linked(f"client_id: backup-user\nvalue {SECRET}") == ["weak_id", "weak_secret"]
    assert sorted(linked(f"client_id=backup-user value {SECRET} at endpoint=db.example.com")) == ["weak_endpoint", "weak_id", "weak_secret"]
    assert linked(f"{KEY} {SECRET}") == ["weak_secret"]


def test_scope_and_reach_bound_the_join():
    assert linked(f"client_id: backup-user\n\nvalue {SECRET}") == []
    assert linked("client_id: backup-user" + " x" * s.REACH + f" value {SECRET}") == []


def test_agrees_with_all_pairs():
    import random

    rnd = random.Random(6)
    bag = [SECRET, "client_id=abcd", "host=db.local", "\n\n", "w " * 30, KEY, "password=hunter22"]
    for _ in range(200):
        text = " ".join(rnd.choice(bag) for _ in range(rnd.randint(1, 12)))
        base = s.base_spans(text)
        weak = [w for w in s._weak_parts(text) if not any(b[0] < w[1] and w[0] < b[1] for b in base)]
        scope = lambda p: sum(m.start() < p[0] for m in s._BREAK.finditer(text))
        near = lambda a, b: b[0] <= a[1] + s.REACH and b[1] >= a[0] - s.REACH and scope(a) == scope(b)
        want = []
        for w in weak:
            have = {s._ROLE[p[2]] for p in base + weak if near(w, p)}
            role = s._ROLE[w[2]]
            if role == "secret" and have & {"id", "endpoint"} or role == "id" and "secret" in have or role == "endpoint" and {"secret", "id"} <= have:
                want.append(w)
        assert sorted(s.linked_spans(text, base)) == sorted(want)


def test_empty_and_odd_rows(make_docs, odd_rows):
    assert s.secret_report(make_docs([])).collect() == []
    assert s.secret_report(make_docs(odd_rows)).count() == len(odd_rows)


def test_many_parts_in_one_text_are_quick():
    text = f"client_id=abcd {SECRET} " * 5000
    assert len(s.linked_spans(text, [])) == 10000
