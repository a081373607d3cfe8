from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import sharding


def check(rows, got, limit):
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t in rows)
    size, count, at = defaultdict(int), Counter(), {}
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
        at[r.shard] = r
        assert len(r.shard) == r.depth
    for s, r in at.items():
        assert r.shard_bytes == size[s]
        assert size[s] <= limit or count[s] == 1 or r.oversize
    for a in at:  # prefixes do not nest, and only an oversized parent was split
        assert not any(b != a and b.startswith(a) for b in at)
        if a:
            assert sum(v for b, v in size.items() if b.startswith(a[:-1])) > limit


def test_every_shard_fits(make_docs):
    rows = [(i, "x" * (i % 97 * 11)) for i in range(3000)]
    got = sharding.assign_shards(make_docs(rows), limit=5000).collect()
    check(rows, got, 5000)
    assert not any(r.oversize for r in got) and len({r.shard for r in got}) > 100


def directory_shards(rows, limit):
    """Shards of (code, bytes) rows put one by one into a directory that doubles when a bucket of its own depth splits."""
    buckets = {"": []}
    directory, depth = {"": ""}, 0
    for row in rows:
        digits = f"{row[0] % 2**64:064b}"
        at = directory[digits[:depth]]
        buckets[at].append(row)
        waiting = [at]
        while waiting:
            at = waiting.pop()
            if len(buckets[at]) < 2 or sum(b for _, b in buckets[at]) <= limit or len(at) == sharding.MAX_BITS:
                continue
            if len(at) == depth:
                directory = {k + d: v for k, v in directory.items() for d in "01"}
                depth += 1
            held = buckets.pop(at)
            for child in (at + "0", at + "1"):
                buckets[child] = [r for r in held if f"{r[0] % 2**64:064b}".startswith(child)]
                waiting.append(child)
            directory |= {k: k[: len(at) + 1] for k, v in directory.items() if v == at}
    return {code: at for at, held in buckets.items() for code, _ in held}


def test_shards_are_those_of_a_directory_built_row_by_row(make_docs):
    docs = make_docs([(i, "ä" * (i * i % 83)) for i in range(400)] + [(401, "z" * 2000)])
    codes = docs.select("doc_id", sharding.row_code().alias("code"), F.octet_length("text").alias("n")).collect()
    want = directory_shards([(r.code, r.n) for r in codes], 900)
    got = {r.doc_id: r.shard for r in sharding.assign_shards(docs, limit=900, step=2).collect()}
    assert got == {r.doc_id: want[r.code] for r in codes} and len(set(got.values())) > 20


def test_copies_of_one_row_and_a_hot_key_split(make_docs):
    rows = [(7, "same text")] * 2000 + [(None, "y" * (i % 50)) for i in range(1000)]
    got = sharding.assign_shards(make_docs(rows), limit=900).collect()
    check(rows, got, 900)
    assert not any(r.oversize for r in got)


def test_odd_rows(make_docs, odd_rows):
    got = sharding.assign_shards(make_docs(odd_rows, extra=True), limit=400).collect()
    check(odd_rows, got, 400)
    assert [r.oversize for r in got if r.doc_id == 8] == [True]


def test_empty(make_docs):
    assert sharding.assign_shards(make_docs([])).collect() == []


def test_no_python_in_the_plan(make_docs):
    plan = sharding.assign_shards(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
