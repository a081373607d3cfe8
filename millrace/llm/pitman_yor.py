"""A hierarchical Pitman-Yor bigram model of the corpus, seated by Gibbs sampling in shards.

The word before is a restaurant, the words that follow are its dishes, and all
restaurants share one parent: every table of a dish sends a customer to the
root, whose own base gives every word the same chance. Restaurants live in
shards by a hash of their word; the root is cut by a hash of the dish. The work
goes in rounds of messages between groups that Spark shuffles: restaurants tell
the root how many tables each dish has, the root seats these customers anew and
answers with each dish's chance, the restaurants seat theirs anew with it. In
the last round they give the averaged predictive probability of every pair of
words that a block of documents has, and the blocks add up their documents.

A group is a shard of restaurants, a piece of the root, or a block of
documents; each holds numpy arrays of bounded size, packed in binary columns. A
shard holds about SHARD_BYTES of text, however much there is. Restaurants that
would outgrow it are dealt out by dish; such parts know the others' tables from
the round before. Words are told by hashes.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, text_of

#: Discount and strength of the root and of the restaurants below it.
ROOT, BELOW = (0.5, 1.0), (0.75, 1.0)
#: Rounds between restaurants and root; sweeps that are left out, and that are averaged, in each.
ROUNDS, BURN_IN, AVERAGED = 2, 1, 2
#: Dishes of so many customers at most get all their tables in one draw; weights of tables held at once for it.
TOGETHER, WEIGHTS = 256, 1 << 17
#: So few of the other dishes move one by one, not side by side; random numbers drawn at once for one.
FEW, DRAWS = 48, 1 << 14
SEED = 13
#: Text that one shard counts, and that one block of documents holds.
SHARD_BYTES, BLOCK_CHARS = 18 << 20, 8_000_000
#: A bounded sample tells which restaurants are so large that they are dealt out.
SAMPLE_DOCS, LARGE_WORDS = 4_000, 1_024

_ROW = "key long, origin long, payload binary, ids array<{kind}>, held array<boolean>, tot_at array<long>, tot array<double>"
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)


#: The key of the end of a text, which also stands before every text.
END = word_key("")
#: The model tells words by the upper 48 bits of their keys, the base by all 64.
SHORT = np.uint64(16)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: unsigned ones in the least width that holds them, byte by byte of all their entries, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "ui":
            top = int(a.max()) if a.size else 0
            a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).data.cast("B") if a.size else b""
        body = pa.compress(raw, "zstd", asbytes=True) if a.size else b""
        out.append(struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(raw), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        kind, raw, size = struct.unpack_from("<2sQQ", data, at)
        at += 18
        body = pa.decompress(data[at : at + size], raw, "zstd", asbytes=True) if raw else b""
        kind = np.dtype(kind.decode())
        entries = np.empty((raw // kind.itemsize, kind.itemsize), np.uint8)
        for i, column in enumerate(np.frombuffer(body, np.uint8).reshape(kind.itemsize, -1)):
            entries[:, i] = column
        out.append(entries.reshape(-1).view(kind))
        at += size
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as their differences."""
    return np.diff(keys.astype(np.uint64), prepend=np.uint64(0))


def climbed(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value, and the distinct values, ascending; values are not negative."""
    bits = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + bits > 63:  # values and places do not fit in one word
        distinct, of = np.unique(values, return_inverse=True)
        return of.astype(np.int32), distinct
    packed = np.sort(values.astype(np.int64) << bits | np.arange(len(values)))
    places = packed & (1 << bits) - 1
    packed >>= bits
    new = np.append(True, packed[1:] != packed[:-1])[: len(packed)]
    of = np.empty(len(values), np.int32)
    of[places] = np.cumsum(new, dtype=np.int32) - 1
    return of, packed[new]


# --- seating --------------------------------------------------------------------------------------------------


def seat(counts, rooms, base, n_rooms, discount, strength, rng, burn_in=BURN_IN, averaged=AVERAGED, elsewhere=None, moves=None, times=1.0):
    """Mean tables of each dish and each room after Gibbs sweeps over ``counts`` customers of a dish in its room.

    A sweep seats every customer of each dish anew. A dish of at most TOGETHER
    customers draws its number of tables from the exact chances of all numbers,
    see ``_redraw``. Of larger ones it takes every customer from its table, one
    after the other, and seats it again: at a table of the dish by the table's
    others less the discount, at a new one by the room's pull times the dish's
    ``base``. These move side by side, so a room's tables are those before the
    step. ``elsewhere`` is what a room has in other shards, or ``times`` how
    often this one stands for all. ``moves`` has all dishes move by customers,
    and ends a sweep after so many of a dish; the model does not use it.
    """
    counts = np.asarray(counts, np.int64)
    order = np.argsort(-counts, kind="stable")
    c, room, base = counts[order], np.asarray(rooms, np.int64)[order], np.asarray(base, float)[order]
    far = np.zeros(n_rooms) if elsewhere is None else np.asarray(elsewhere, float)
    t = (c > 0).astype(np.int64)
    several = int(np.searchsorted(-c, -1))  # dishes with two customers or more
    large = int(np.searchsorted(-c, -TOGETHER)) if moves is None else several
    single = np.bincount(room[several:], t[several:], n_rooms)
    here = np.bincount(room, t, n_rooms).astype(float)
    if several:
        pull = (strength + discount * (here * times + far))[room[:several]] * base[:several]
        grown = pull * np.log((pull + c[:several] - discount) / (pull + 1 - discount))
        t[:several] = np.clip(1 + grown.astype(np.int64), 1, c[:several])
        here = single + np.bincount(room[:several], t[:several], n_rooms)
    if large:
        seats = _Seats(c[:large], t[:large])
    sum_t, sum_here = np.zeros(len(c)), np.zeros(n_rooms)
    for sweep in range(burn_in + averaged):
        if several > large:
            small = slice(large, several)
            t[small] = _redraw(c[small], room[small], base[small], here * times + far, discount, strength, rng)
            here = single + np.bincount(room[:several], t[:several], n_rooms)
        if large:
            _sweep(c[:large], room[:large], base[:large], t, seats, here, far, times, discount, strength, rng, moves)
        if sweep >= burn_in:
            sum_t += t
            sum_here += here
    out = np.empty(len(c))
    out[order] = sum_t / averaged
    return out, sum_here / averaged


@lru_cache(4)
def log_ways(discount: float, most: int) -> np.ndarray:
    """Logarithms of the ways to seat c customers (row) at t tables (column), each weighted by its sizes' factors."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, most + 1):
        out[c, 1:] = out[c - 1, :-1]
        t = np.arange(1, c)
        out[c, t] = np.logaddexp(out[c, t], np.log(c - 1 - discount * t) + out[c - 1, t])
    return out


def _redraw(c, room, base, tables, discount, strength, rng):
    """New tables of all dishes, ``c`` descending, in rooms of so many ``tables``.

    A room of T tables has a factor proportional to the Gamma function of
    strength / discount + T. With a gamma variable of that shape drawn for the
    room, its dishes no longer depend on each other: t tables have the chance of
    their ways times the t-th power of discount * variable * base.
    """
    used, of = np.unique(room, return_inverse=True)
    each = discount * rng.standard_gamma(strength / discount + tables[used]) if discount else np.full(len(used), strength)
    power = np.log(each[of] * base)
    ways = log_ways(discount, TOGETHER)
    out = np.empty(len(c), np.int64)
    sizes, starts = np.unique(-c, return_index=True)
    for size, lo, hi in zip((-sizes).tolist(), starts.tolist(), np.append(starts[1:], len(c)).tolist()):
        t = np.arange(1, size + 1)[:, None]
        for at in range(lo, hi, max(1, WEIGHTS // size)):
            stop = min(hi, at + max(1, WEIGHTS // size))
            weight = t * power[at:stop]
            weight += ways[size, 1 : size + 1, None]
            weight -= weight.max(axis=0)
            np.exp(weight, out=weight)
            np.cumsum(weight, axis=0, out=weight)
            out[at:stop] = 1 + (weight[:-1] <= rng.random(stop - at) * weight[-1]).sum(axis=0)
    return out


class _Seats:
    """The table of every customer. A dish of c customers, from place ``start`` on, has c places for tables."""

    def __init__(self, c, t):
        ends = np.cumsum(c)
        total = int(ends[-1])
        kind = np.int32 if total < 1 << 31 else np.int64
        self.start = ends - c
        # the k-th table holds about 1/k of the first
        dish = np.repeat(np.arange(len(c)), t)
        place = np.arange(len(dish)) - np.repeat(np.cumsum(t) - t, t)
        share = 1.0 / (place + 1)
        sizes = 1 + ((c - t)[dish] * share / np.bincount(dish, share, len(c))[dish]).astype(np.int64)
        first = np.cumsum(t) - t
        sizes[first] += c - np.add.reduceat(sizes, first)
        at = self.start[dish] + place
        self.sizes = np.zeros(total, kind)
        self.sizes[at] = sizes
        self.table = np.repeat(at.astype(kind), sizes)
        # of each dish a stack of free places, its top at c - t
        self.free = (np.repeat(2 * self.start + c - 1, c) - np.arange(total)).astype(kind)


def _sweep(c, room, base, t, seats, here, far, times, discount, strength, rng, moves=None):
    steps = int(c[0]) if moves is None else min(moves, int(c[0]))
    beside = min(steps, int(c[FEW - 1])) if FEW <= len(c) else 0
    start, others, stay = seats.start, c - 1.0, c - 1 - discount * t[: len(c)]
    pull, stale = None, True
    # dishes with more than j customers stand first
    for j, n in enumerate(np.searchsorted(-c, -np.arange(beside)).tolist()):
        mine = start[:n] + j
        left = seats.table[mine]
        size = seats.sizes[left] - 1
        seats.sizes[left] = size
        gone = (size == 0).nonzero()[0]
        if gone.size:
            seats.free[start[gone] + c[gone] - t[gone]] = left[gone]
            t[gone] -= 1
            stay[gone] += discount
            np.subtract.at(here, room[gone], 1.0)
        pull = _pull(room[:n], base[:n], here, far, times, discount, strength) if gone.size or stale else pull[:n]
        new = (rng.random(n) * (pull + stay[:n]) < pull).nonzero()[0]
        # the whole part of y chooses another customer, its fraction whether its table is taken: by its size less the discount
        y = rng.random(n) * others[:n]
        other = y.astype(np.int64)
        chosen = seats.table[start[:n] + other + (other >= j)]
        size = seats.sizes[chosen]
        todo = ((y - other) * size >= size - discount).nonzero()[0]
        while todo.size:
            y = rng.random(todo.size) * others[todo]
            other = y.astype(np.int64)
            pick = seats.table[start[todo] + other + (other >= j)]
            size = seats.sizes[pick]
            chosen[todo] = pick
            todo = todo[(y - other) * size >= size - discount]
        if new.size:
            chosen[new] = seats.free[start[new] + c[new] - t[new] - 1]
            t[new] += 1
            stay[new] -= discount
            np.add.at(here, room[new], 1.0)
        stale = new.size > 0
        seats.sizes[chosen] += 1
        seats.table[mine] = chosen
    # the few dishes with most customers go on one by one
    for i in range(int(np.searchsorted(-c, -beside)) if beside < steps else 0):
        lo, many, r = int(start[i]), int(c[i]), int(room[i])
        places = slice(lo, lo + many)
        seats.table[places] -= lo
        seats.free[places] -= lo
        table, sizes, free = (memoryview(a[places]) for a in (seats.table, seats.sizes, seats.free))
        chance, away, tables, own = float(base[i]), float(far[r]), int(t[i]), float(here[r])

        def opens():
            """The chance that the customer that left takes a new table."""
            pull = (strength + discount * (own * times + away)) * chance
            return pull / (pull + many - 1 - discount * tables)

        share = opens()
        for begin in range(beside, many if moves is None else min(many, moves), DRAWS):
            stop = min(begin + DRAWS, many if moves is None else min(many, moves))
            # another customer, and the size that its table must exceed to be taken: it is by its size less the discount
            y = rng.random(stop - begin) * (many - 1)
            other = y.astype(np.int64)
            least = discount / (1 - (y - other))
            other += other >= np.arange(begin, stop)
            for k, x, at, bound in zip(range(begin, stop), rng.random(stop - begin).tolist(), other.tolist(), least.tolist()):
                left = table[k]
                size = sizes[left] = sizes[left] - 1
                if not size:
                    free[many - tables] = left
                    tables -= 1
                    own -= 1
                    share = opens()
                if x < share:
                    to = free[many - tables - 1]
                    size = sizes[to]
                    tables += 1
                    own += 1
                    share = opens()
                else:
                    to = table[at]
                    size = sizes[to]
                    while size <= bound:
                        z = rng.random() * (many - 1)
                        at = int(z)
                        bound = discount / (1 - (z - at))
                        to = table[at + (at >= k)]
                        size = sizes[to]
                sizes[to] = size + 1
                table[k] = to
        seats.table[places] += lo
        seats.free[places] += lo
        t[i], here[r] = tables, own


def _pull(room, base, here, far, times, discount, strength):
    """What draws a customer of each dish to a new table."""
    return (strength + discount * (here[room] * times + far[room])) * base


# --- blocks of documents --------------------------------------------------------------------------------------


class Layout:
    """Which group holds what: restaurants 0 to k - 1, the root's pieces up to 2 k - 1, then blocks."""

    def __init__(self, shards: int, large: list[tuple[int, int]] = ()):
        self.k = shards
        self.large = {key: (i, parts) for i, (key, parts) in enumerate(large)}  # at most LARGE_WORDS

    def of_short(self, keys: np.ndarray) -> np.ndarray:
        """The shard of a short key by its upper bits: ascending keys have ascending shards."""
        return (keys.astype(np.uint64) >> np.uint64(16)) * np.uint64(self.k) >> np.uint64(32)

    def of_part(self, key: int, parts: int) -> np.ndarray:
        """The shards of the parts of a large restaurant."""
        return self.of_short(mix(np.uint64(key) + np.uint64(_MIX[2]) * np.arange(1, parts + 1, dtype=np.uint64)) >> SHORT)


def _token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, local word) of every token in order, without ends, and the words."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat, doc = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py():
        flat, doc = flat.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    return doc, coded.indices.to_numpy(), coded.dictionary


def block_rows(layout: Layout, block: int, texts: pa.Array, train: np.ndarray):
    """(key, payload) of a block: its pairs for each shard, its words for each piece of the root, and what it keeps."""
    n_docs = len(texts)
    doc, word, words = _token_rows(texts)
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False), repeat(1)), np.uint64, len(words))  # as word_key
    keys = np.append(keys, np.uint64(END))
    ascending = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[ascending] = np.arange(len(keys))
    keys, end = keys[ascending], int(rank[-1])
    short = keys >> SHORT
    total = len(doc) + n_docs
    follows, of = np.full(total, end, np.int64), np.empty(total, np.int64)
    at = np.arange(len(doc)) + doc
    follows[at], of[at] = rank[word], doc
    of[np.cumsum(np.bincount(doc, minlength=n_docs)) + np.arange(n_docs)] = np.arange(n_docs)
    before = np.append(np.int64(end), follows[:-1])

    # contexts: a word each, and one more for each part of a large one
    context, context_key, where = before, short, layout.of_short(short)
    for key, (_, parts) in layout.large.items():
        found = int(np.searchsorted(short, np.uint64(key)))
        if parts > 1 and found < len(short) and short[found] == key:
            mine = np.flatnonzero(before == found)
            part = (mix(short[follows[mine]]) >> np.uint64(7)) % np.uint64(parts)
            context = context.copy() if context is before else context
            context[mine] = len(context_key) + part.astype(np.int64)
            context_key = np.append(context_key, np.full(parts, key, np.uint64))
            where = np.append(where, layout.of_part(key, parts))
    by_shard = np.lexsort((context_key, where))
    place = np.empty(len(where), np.int64)
    place[by_shard] = np.arange(len(where))
    context, context_key, where = place[context], context_key[by_shard], where[by_shard]

    if max(len(context_key), len(keys)) < 1 << 22 and n_docs < 1 << 20:
        packed = np.sort(context.astype(np.uint64) << np.uint64(42) | follows.astype(np.uint64) << np.uint64(20) | of.astype(np.uint64))
        context, follows, of = (packed >> np.uint64(42)).astype(np.int64), (packed >> np.uint64(20) & np.uint64((1 << 22) - 1)).astype(np.int64), (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
    else:  # a text of millions of different words
        by = np.lexsort((of, follows, context))
        context, follows, of = context[by], follows[by], of[by]
    starts = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (follows[1:] != follows[:-1])))
    times = np.diff(np.append(starts, total))
    learnt = np.add.reduceat(train[of].astype(np.int64), starts)
    context, follows = context[starts], follows[starts]
    counts = np.bincount(follows, learnt, len(keys)).astype(np.int64)

    cuts = np.searchsorted(where[context], np.arange(layout.k + 1))
    for shard in range(layout.k):
        lo, hi = cuts[shard], cuts[shard + 1]
        if hi > lo:
            heads = np.flatnonzero(np.append(True, context[lo + 1 : hi] != context[lo : hi - 1]))
            used, ids = np.unique(follows[lo:hi], return_inverse=True)
            yield shard, pack(steps(context_key[context[lo:hi][heads]]), np.diff(np.append(heads, hi - lo)), steps(short[used]), ids, learnt[lo:hi])
    word_cuts = np.searchsorted(layout.of_short(short), np.arange(layout.k + 1))
    for piece in range(layout.k):
        lo, hi = word_cuts[piece], word_cuts[piece + 1]
        if hi > lo:
            yield layout.k + piece, pack(steps(keys[lo:hi]), counts[lo:hi])
    # within a context the words ascend
    jumps = np.where(np.append(True, context[1:] != context[:-1]), follows, np.diff(follows, prepend=0))
    yield 2 * layout.k + block, pack(of, times, jumps, np.diff(np.append(np.flatnonzero(np.append(True, context[1:] != context[:-1])), len(context))))


def _encode(layout: Layout, kind: pa.DataType):
    names = ["key", "origin", "payload", "ids", "held", "tot_at", "tot"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        held, weight = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, texts, out = (table.column(i).combine_chunks() for i in range(3))
            apart = out.to_numpy(zero_copy_only=False).astype(bool)
            rows = list(block_rows(layout, block, texts, ~apart))
            for at in range(0, len(rows), 16):
                some = rows[at : at + 16]
                own = [key == 2 * layout.k + block for key, _ in some]
                columns = [
                    [k for k, _ in some], [block] * len(some), [p for _, p in some],
                    [ids.to_pylist() if o else None for o in own], [apart.tolist() if o else None for o in own], [None] * len(some), [None] * len(some),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for b in batches:
            start = 0
            for i, size in enumerate(pc.utf8_length(b.column(1)).to_pylist()):
                weight += size + 1
                if weight >= BLOCK_CHARS:
                    held.append(b.slice(start, i + 1 - start))
                    yield from flush()
                    held, weight, start, block = [], 0, i + 1, block + 1
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield from flush()

    return run


# --- the groups' rounds ---------------------------------------------------------------------------------------

#: Places of the totals: training tokens, distinct words; the root's customers and tables; from here two for each large word.
N, V, CUSTOMERS, TABLES, LARGE = 0, 1, 2, 3, 4


class _Shard:
    """The restaurants of a shard, from the pairs of all blocks."""

    def __init__(self, layout: Layout, rows: pa.Table):
        rows = rows.sort_by("origin")
        self.layout, self.blocks = layout, rows["origin"].to_pylist()
        contexts, degrees, words, places, learnt, self.cuts, known = [], [], [], [], [], [0], 0
        for payload in rows["payload"]:
            context, degree, used, ids, n = unpack(payload.as_py())
            contexts.append(climbed(context))
            degrees.append(degree)
            words.append(climbed(used))
            places.append(ids.astype(np.int64) + known)
            learnt.append(n)
            self.cuts.append(self.cuts[-1] + len(ids))
            known += len(used)
        room, self.room_keys = pd.factorize(np.concatenate(contexts))
        word, self.word_keys = pd.factorize(np.concatenate(words))
        self.of_pair, pairs = numbered(np.repeat(room, np.concatenate(degrees)) * len(self.word_keys) + word[np.concatenate(places)])
        self.counts = np.bincount(self.of_pair, np.concatenate(learnt), len(pairs)).astype(np.int64)
        self.room, self.word = np.divmod(pairs, len(self.word_keys))
        self.customers = np.bincount(self.room, self.counts, len(self.room_keys))
        self.piece = layout.of_short(self.word_keys)

    def large(self) -> list[tuple[int, int]]:
        """(room here, place among the large words) of restaurants that other shards have parts of."""
        apart = {k: i for k, (i, parts) in self.layout.large.items() if parts > 1}
        here = np.flatnonzero(np.isin(self.room_keys, np.array(list(apart), np.uint64))).tolist()
        return sorted(((room, apart[int(self.room_keys[room])]) for room in here), key=lambda at: at[1])

    def told(self, tables: np.ndarray, in_rooms: np.ndarray, key: int):
        """Messages to the root: each dish's tables over these restaurants; and the totals of large ones."""
        per_word = np.bincount(self.word, tables, len(self.word_keys))
        at, tot = [], []
        for room, i in self.large():
            at += [LARGE + 2 * i, LARGE + 2 * i + 1]
            tot += [float(self.customers[room]), float(in_rooms[room])]
        for piece, mine in self.asked():
            yield self.layout.k + piece, key, pack(steps(self.word_keys[mine]), per_word[mine].astype(np.int64).astype(np.uint64)), at, tot
            at, tot = [], []

    def asked(self):
        """(piece of the root, its words here with ascending keys)."""
        order = np.argsort(self.word_keys)
        cuts = np.searchsorted(self.piece[order], np.arange(self.layout.k + 1))
        for piece in range(self.layout.k):
            if cuts[piece + 1] > cuts[piece]:
                yield piece, order[cuts[piece] : cuts[piece + 1]]

    def answered(self, messages: dict[int, bytes], totals: dict[int, float]) -> np.ndarray:
        """The root's chance of each word."""
        held = np.zeros(len(self.word_keys))
        for piece, mine in self.asked():
            held[mine] = unpack(messages[self.layout.k + piece])[0]
        discount, strength = ROOT
        even = 1.0 / (totals.get(V, 0.0) + 1)
        return (held + (strength + discount * totals.get(TABLES, 0.0)) * even) / (strength + totals.get(CUSTOMERS, 0.0))

    def sample(self, chance: np.ndarray, totals: dict[int, float], before: np.ndarray, rng):
        """Mean tables of each pair and room; the customers of each room; ``before``: its tables here when the totals were taken."""
        served = np.flatnonzero(self.counts)
        elsewhere, customers = np.zeros(len(self.room_keys)), self.customers.copy()
        for room, i in self.large():
            customers[room] = totals.get(LARGE + 2 * i, customers[room])
            elsewhere[room] = max(0.0, totals.get(LARGE + 2 * i + 1, 0.0) - before[room])
        tables = np.zeros(len(self.counts))
        tables[served], rooms = seat(self.counts[served], self.room[served], chance[self.word[served]], len(self.room_keys), *BELOW, rng, elsewhere=elsewhere)
        return tables, rooms, elsewhere, customers

    def scores(self, chance, tables, rooms, elsewhere, customers):
        """log10 of the averaged predictive probability of each pair, for each block."""
        discount, strength = BELOW
        pull = strength + discount * (rooms + elsewhere)
        p = (self.counts - discount * tables + pull[self.room] * chance[self.word]) / (strength + customers[self.room])
        logs = np.log10(p).astype(np.float32)[self.of_pair]
        for i, block in enumerate(self.blocks):
            yield 2 * self.layout.k + block, pack(logs[self.cuts[i] : self.cuts[i + 1]])


def _word_counts(rows: pa.Table):
    """The counts of a root piece's words over all blocks; and each block's words."""
    rows = rows.sort_by("origin")
    parts = [unpack(p.as_py()) for p in rows["payload"]]
    of, words = pd.factorize(np.concatenate([climbed(k) for k, _ in parts]))
    counts = np.bincount(of, np.concatenate([n for _, n in parts]), len(words)).astype(np.int64)
    cuts = np.cumsum([0] + [len(k) for k, _ in parts])
    return counts, [(b, of[cuts[i] : cuts[i + 1]]) for i, b in enumerate(rows["origin"].to_pylist())]


_NAMES = ("key", "origin", "payload", "tot_at", "tot")
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()))
_MESSAGE = "key long, origin long, payload binary, tot_at array<long>, tot array<double>"


def _messages(rows) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], list(_NAMES))


def _totals(messages: pa.Table) -> dict[int, float]:
    told = messages["told"][0].as_py() if messages.num_rows else None
    return {x["at"]: x["tot"] for x in told or []}


def _started(layout: Layout):
    """First round: every dish of a restaurant has one table; the root's pieces count words."""

    def run(rows: pa.Table) -> pa.Table:
        key = rows["key"][0].as_py()
        if key < layout.k:
            shard = _Shard(layout, rows)
            tables = (shard.counts > 0).astype(float)
            return _messages(shard.told(tables, np.bincount(shard.room, tables, len(shard.room_keys)), key))
        if key < 2 * layout.k:
            counts, _ = _word_counts(rows)
            return _messages([(key, key, None, [N, V], [float(counts.sum()), float((counts > 0).sum())])])
        return _messages([])

    return run


def _root(layout: Layout, turn: int):
    """A piece of the root seats the tables it is told of and answers each shard, in the order it was asked."""

    def run(messages: pa.Table) -> pa.Table:
        key = messages["key"][0].as_py()
        totals = _totals(messages)
        asked = messages.filter(pc.is_valid(messages["payload"])).sort_by("origin")
        if not asked.num_rows:
            return _messages([])
        parts = [unpack(p.as_py()) for p in asked["payload"]]
        of, words = pd.factorize(np.concatenate([climbed(k) for k, _ in parts]))
        customers = np.bincount(of, np.concatenate([n for _, n in parts]), len(words)).astype(np.int64)
        served = np.flatnonzero(customers)
        tables = np.zeros(len(words))
        even = np.full(len(served), 1.0 / (totals.get(V, 0.0) + 1))
        rng = np.random.default_rng([SEED, turn, key])
        tables[served], room = seat(customers[served], np.zeros(len(served), np.int64), even, 1, *ROOT, rng, times=layout.k)
        held = (customers - ROOT[0] * tables).astype(np.float32)
        out, at = [], 0
        tot = [float(customers.sum()), float(room[0])]
        for origin, (k, _) in zip(asked["origin"].to_pylist(), parts):
            out.append((origin, key, pack(held[of[at : at + len(k)]]), [CUSTOMERS, TABLES] if not at else [], tot if not at else []))
            at += len(k)
        return _messages(out)

    return run


def _below(layout: Layout, turn: int, last: bool):
    """Restaurants seat anew with the root's answers; in the last round they score the blocks' pairs, and the words are counted for them."""

    def run(rows: pa.Table, messages: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _messages([])
        key = rows["key"][0].as_py()
        if key >= 2 * layout.k or (key >= layout.k and not last):
            return _messages([])
        if key >= layout.k:
            counts, blocks = _word_counts(rows)
            return _messages((2 * layout.k + block, key, pack(counts[of]), [], []) for block, of in blocks)
        shard, totals = _Shard(layout, rows), _totals(messages)
        answers = dict(zip(messages["origin"].to_pylist(), (p.as_py() for p in messages["payload"])))
        chance = shard.answered(answers, totals)
        one_each = np.bincount(shard.room, shard.counts > 0, len(shard.room_keys))
        tables, rooms, elsewhere, customers = shard.sample(chance, totals, one_each, np.random.default_rng([SEED, turn, key]))
        if last:
            return _messages((to, key, p, [], []) for to, p in shard.scores(chance, tables, rooms, elsewhere, customers))
        return _messages(shard.told(np.rint(tables), rooms, key))

    return run


def _documents(layout: Layout, kind: pa.DataType):
    """A block's documents: tokens, known tokens, the base's and the model's sums of logarithms."""

    def run(rows: pa.Table, messages: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])
        if not rows.num_rows or rows["key"][0].as_py() < 2 * layout.k:
            return schema.empty_table()
        messages = messages.sort_by("origin")
        of, times, jumps, degree = unpack(rows["payload"][0].as_py())
        upto, heads = np.cumsum(jumps, dtype=np.int64), np.cumsum(degree, dtype=np.int64) - degree
        follows = upto - np.repeat(upto[heads] - jumps[heads], degree)  # the words ascend in each context
        from_shards, from_root = [], []
        for origin, payload in zip(messages["origin"].to_pylist(), messages["payload"]):
            (from_shards if origin < layout.k else from_root).append(unpack(payload.as_py())[0])
        scores, counts = np.concatenate(from_shards), np.concatenate(from_root).astype(np.int64)[follows]
        ids, held = rows["ids"][0].as_py(), rows["held"][0].as_py()
        add = lambda values: np.bincount(of, np.repeat(values, times), len(ids))
        columns = [ids, held, np.bincount(of, minlength=len(ids)), add(counts > 0).astype(np.int64), add(np.log10(counts + 0.1)), add(scores.astype(float))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _summed(messages: DataFrame) -> DataFrame:
    """One row: the totals that the messages carry, as (place, sum) pairs."""

    def flat(batches):
        for b in batches:
            at, tot = (pc.list_flatten(b.column(b.schema.get_field_index(c))) for c in ("tot_at", "tot"))
            yield pa.RecordBatch.from_arrays([at, tot], ["at", "tot"])

    each = messages.mapInArrow(flat, "at long, tot double").groupBy("at").agg(F.sum("tot").alias("tot"))
    return each.agg(F.collect_list(F.struct("at", "tot")).alias("told"))  # at most LARGE + 2 * LARGE_WORDS pairs


def plan_layout(docs: DataFrame, shard_bytes: int = SHARD_BYTES, sample_docs: int = SAMPLE_DOCS) -> Layout:
    """Shards by the bytes of text; words so frequent that their restaurant is dealt out, by a bounded sample."""
    text = text_of(docs).cast("string")
    size = docs.agg(F.sum(F.octet_length(text) + 1).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(1, -(-(size["bytes"] or 0) // shard_bytes))
    if shards == 1:
        return Layout(1)
    share = min(1.0, sample_docs / size["rows"])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    words = chosen.select(F.explode(F.split(F.translate("text", upper, upper.lower()), f"[{SPACE_CLASS}]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 1
    large = [(word_key(r["word"]) >> 16, r["n"] / total) for r in counted.orderBy(F.desc("n"), "word").limit(LARGE_WORDS).collect()]
    large.append((END >> 16, chosen.count() / total))
    return Layout(shards, [(k, min(shards, int(s * shards * 4) + 1)) for k, s in large if s * shards * 4 >= 1])


def score_documents(docs: DataFrame, held_out, rounds: int = ROUNDS, layout: Layout | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    ``held_out`` is a boolean column; the other rows are learned. Null text is
    empty; a text's tokens are its words, A-Z in lower case, and one end.
    ``score`` is the model's log10 probability of the text, by predictive
    probabilities averaged over samples, and ``perplexity`` is 10 to the power
    of minus the score per token. Repeated rows are learned and scored each;
    null doc_ids are kept. Nothing to learn: every token has chance 1. Other
    columns are not read; no rows give no rows. Reruns agree.
    """
    layout = layout or plan_layout(docs)
    kind_name = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.string() if kind_name == "string" else pa.int32() if kind_name == "int" else pa.int64()
    slim = docs.select("doc_id", text_of(docs).cast("string").alias("text"), held_out.alias("held"))
    n = max(2 * layout.k, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = slim.mapInArrow(_encode(layout, kind), _ROW.format(kind=kind_name)).repartition(n, "key")
    messages = rows.groupBy("key").applyInArrow(_started(layout), _MESSAGE).repartition(n, "key")
    counted = _summed(messages)
    asked = counted
    for turn in range(rounds):
        told = messages.crossJoin(F.broadcast(asked))  # one row of totals
        answers = told.groupBy("key").applyInArrow(_root(layout, turn), _MESSAGE).repartition(n, "key")
        both = _summed(answers).withColumnRenamed("told", "more").crossJoin(F.broadcast(asked)).select(F.concat("told", "more").alias("told"))
        below = rows.groupBy("key").cogroup(answers.crossJoin(F.broadcast(both)).groupBy("key"))
        messages = below.applyInArrow(_below(layout, turn, turn == rounds - 1), _MESSAGE).repartition(n, "key")
        if turn < rounds - 1:
            # the words' totals are those of the first round; the large restaurants' are new
            fresh = _summed(messages).withColumnRenamed("told", "more")
            asked = counted.crossJoin(F.broadcast(fresh)).select(F.concat(F.filter("told", lambda x: x["at"] < LARGE), "more").alias("told"))
    result = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double".format(kind=kind_name)
    scored = rows.groupBy("key").cogroup(messages.groupBy("key")).applyInArrow(_documents(layout, kind), result)
    total = lambda at: F.coalesce(F.element_at(F.map_from_entries("told"), F.lit(at).cast("long")), F.lit(0.0))
    every = scored.crossJoin(F.broadcast(counted))
    return every.select(
        "doc_id", "held_out", "n_tokens", "n_known", total(N).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(total(N) + 0.1 * (total(V) + 1))).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def held_out_tenth(doc_id):
    """The rows no model learns from: crc32 of the id as text leaves 0 modulo 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0
