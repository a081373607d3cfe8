"""The manifest against a tree built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return sha(*(enc(row[f]) for f in merkle.FIELDS))


def grow(nodes):
    """Levels of a tree of [digest]; then the siblings of each node, level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def steps(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 8 * 8
        out.append((nodes[run:i], nodes[i + 1 : run + 8]))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: grow([leaf(r) for r in rs]) for g, rs in groups.items()}
    crown = grow([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(crown, k)
            told = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                told["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            folded = leaf(told)
            for left, right in path:
                folded = sha(*left, folded, *right)
            root = crown[-1][0]
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root, sha(*(x for a, b in path for x in a + b)), folded, folded == root))
    return sorted(out, key=str)


def run(docs, **options):
    return sorted((tuple(r) for r in merkle.audit_manifest(docs, merkle.lower_cased_third(docs), **options).collect()), key=str)


def rows_of(docs):
    return [r.asDict() for r in docs.select(*merkle.FIELDS).collect()]


def some(n, langs):
    rnd = random.Random(n)
    return [(i, rnd.choice(["Some Text", "low", None, "", "ÄÖ Z"]) or None, rnd.choice(langs), rnd.choice(["s", None])) for i in range(n)]


@pytest.mark.parametrize("n,depth", [(1, 4), (8, 4), (9, 4), (700, 4), (700, 2), (700, 1), (64, 2), (65, 2)])
def test_equals_a_tree_built_node_by_node(make_docs, n, depth):
    docs = make_docs(some(n, ["en"] * 6 + ["de", "", None, "ß"]))
    assert run(docs, depth=depth) == brute(rows_of(docs))


def test_many_groups_and_single_leaves(make_docs):
    docs = make_docs([(i, "T", f"l{i % 90}" if i < 95 else None) for i in range(100)])
    for depth in (1, 4):
        assert run(docs, depth=depth) == brute(rows_of(docs))


def test_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (None, "LOOSE"), (6, "ONE"), (6, "one two three")]
    docs = make_docs(rows, extra=True).withColumn("pos", F.lit("clash")).withColumn("code", F.lit("clash"))
    assert run(docs) == brute(rows_of(docs))
    assert run(make_docs([])) == []


def test_only_changed_rows_fail(make_docs):
    docs = make_docs([(i, "Upper" if i % 2 else "lower", "en") for i in range(200)])
    bad = {r[0] for r in run(docs) if not r[-1]}
    assert bad == {i for i in range(200) if i % 2 and zlib.crc32(str(i).encode()) % 3 == 0}


def test_proofs_fold_to_the_root(make_docs):
    proofs = merkle.inclusion_proofs(make_docs(some(300, ["a", "b", None])), depth=2).collect()
    assert len(proofs) == 300
    for r in proofs:
        assert merkle.fold(r.leaf, [(s.left, s.right) for s in r.steps]) == r.root
        assert any(merkle.fold(r.leaf, [(s.left, s.right) for s in r.steps[:k]]) == r.subroot for k in range(len(r.steps) + 1))


def test_levels_are_rows_of_one_matrix():
    m = merkle.matrix(hashlib.sha256(bytes([i])).hexdigest() for i in range(21))
    above = merkle.level_above(m)
    assert m.shape == (21, 64) and above.shape == (3, 64)
    assert above[2].tobytes().decode() == hashlib.sha256(m[16:].tobytes()).hexdigest()
