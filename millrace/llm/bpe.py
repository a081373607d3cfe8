"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string is determined by its last token and the encoding
of what comes before it. So for every prefix one number is stored: the only
token that can end that prefix's encoding. A token that matches at the end is
that one if the prefix before it ends in a token that stays apart from it.
Appending bytes extends the table; after an edit it is filled again from the
edit on, until it agrees with the old one over the longest token's length.

Documents are encoded in blocks of rows. The pieces of a block that were not
met before fill their tables side by side: one array step handles the same
prefix length of all of them. A trie tells which tokens end there, and each
pair of tokens is judged once.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Pieces a worker remembers, and token pairs.
CACHE_PIECES, CACHE_PAIRS = 200_000, 500_000
#: Token pairs that the scalar form remembers.
FEW_PAIRS = 50_000
#: Pieces of one block of rows, and new ones whose tables are filled side by side.
BLOCK_PIECES, NEW_PIECES = 200_000, 20_000
#: Bytes of a piece up to which its table is filled beside others'.
SHORT = 48
BLOCK = 1 << 20


class Lookup:
    """Whole numbers from 0 to whole numbers from 0, for arrays at a time; -1 is told for what is not there."""

    def __init__(self, room: int):
        self.bits = max(4, (2 * room).bit_length())
        self.keys, self.values, self.size = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where its search ends."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while left.size:
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        return np.where(self.keys[at] >= 0, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not there yet."""
        self.size += len(keys)
        while len(keys):
            at = self._places(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values = keys[~won], values[~won]


class Vocabulary:
    """Ranks of a byte-level vocabulary: which tokens there are, how each is made, which can be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}
        self.lengths = np.array([len(t) for t in self.tokens])
        self._trie: tuple[Lookup, np.ndarray] | None = None
        self._pairs = Lookup(CACHE_PAIRS)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge made this one of."""
        found = self._parts.get(token)
        if found is None:
            row = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            while len(row) > 2:
                ranked = [(self.ranks.get(row[i] + row[i + 1], 1 << 60), i) for i in range(len(row) - 1)]
                rank, i = min(ranked)
                if rank >= token:
                    raise ValueError(f"token {token} cannot be reached by merges")
                row[i : i + 2] = [row[i] + row[i + 1]]
            found = self._parts[token] = (self.ranks[row[0]], self.ranks[row[1]])
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether these two tokens, side by side, are how their bytes are encoded.

        Goes back in time over the pieces that meet at the boundary: the later
        made of the two is undone first, and no merge of the two may come
        before the merge that used one of them up. Of equal ranks the left
        merge comes first.
        """
        tokens, ranks, a, b, until = self.tokens, self.ranks, left, right, 1 << 60
        while True:
            rank = ranks.get(tokens[a] + tokens[b])
            if rank is not None and rank < until:
                return False
            made_a, made_b = (x if len(tokens[x]) > 1 else -1 for x in (a, b))
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until, a = made_a, self.parts(a)[1]
            else:
                until, b = made_b + 1, self.parts(b)[0]

    def known_apart(self, left: int, right: int) -> bool:
        """``apart``, remembered for some pairs."""
        pair = left << 20 | right
        known = self._apart.get(pair)
        if known is None:
            if len(self._apart) >= FEW_PAIRS:
                self._apart.clear()
            known = self._apart[pair] = self.apart(left, right)
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The only token that can end the encoding of data[:end], given those of the shorter prefixes."""
        get, apart = self.ranks.get, self.known_apart
        for start in range(max(0, end - self.longest), end):
            token = get(data[start:end])
            if token is not None and (not start or apart(last[start], token)):
                return token
        raise ValueError(f"no token ends at byte {end}")

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        last = [0]
        for end in range(1, len(data) + 1):
            last.append(self.last_token(data, end, last))
        return self.walk(last)

    def trie(self) -> tuple[Lookup, np.ndarray]:
        """The next node by ``node << 8 | byte``, and the token of each node or -1. Node 0 is the root."""
        if self._trie is None:
            node = {b"": 0}
            for t in self.ranks:
                for end in range(1, len(t) + 1):
                    node.setdefault(t[:end], len(node))
            moves = np.array([node[p[:-1]] << 8 | p[-1] for p in node if p], np.int64)
            move = Lookup(len(moves))
            move.add(moves, np.arange(1, len(node), dtype=np.int32))
            self._trie = move, np.array([self.ranks.get(p, -1) for p in node], np.int32)
        return self._trie

    def fitting(self, pairs: np.ndarray) -> np.ndarray:
        """``apart`` of many pairs, each ``left << 20 | right``."""
        known = self._pairs.get(pairs)
        new = np.unique(pairs[known < 0])
        if not new.size:
            return known > 0
        if self._pairs.size + new.size > CACHE_PAIRS:
            self._pairs, new = Lookup(CACHE_PAIRS), np.unique(pairs)
        self._pairs.add(new, np.fromiter((self.apart(p >> 20, p & 0xFFFFF) for p in new.tolist()), np.int32, len(new)))
        return self._pairs.get(pairs) > 0

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has. Step by step all prefix tables grow by a byte."""
        move, token_of = self.trie()
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        short = order[lengths[order] <= SHORT]
        size = lengths[short]
        longest = int(size[0]) if len(size) else 0
        data = np.zeros((len(short), longest), np.uint8)
        data[np.arange(longest)[None, :] < size[:, None]] = np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)
        last = np.full((longest + 1, len(short)), -1, np.int32)
        rows, starts, nodes = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for end in range(1, longest + 1):
            n = int(np.searchsorted(-size, -end, side="right"))
            going = rows < n
            rows = np.concatenate([rows[going], np.arange(n, dtype=np.int32)])
            starts = np.concatenate([starts[going], np.full(n, end - 1, np.int32)])
            nodes = move.get(np.concatenate([nodes[going], np.zeros(n, np.int64)]) << 8 | data[rows, end - 1]).astype(np.int64)
            going = nodes >= 0
            rows, starts, nodes = rows[going], starts[going], nodes[going]
            token = token_of[nodes]
            left = np.flatnonzero(token >= 0)
            while left.size:  # each row's longest token first
                row = rows[left]
                first = np.full(n, -1, np.int64)
                first[row[::-1]] = left[::-1]
                first = first[first >= 0]
                fits = starts[first] == 0
                later = np.flatnonzero(~fits)
                at = first[later]
                fits[later] = self.fitting(last[starts[at], rows[at]].astype(np.int64) << 20 | token[at])
                last[end, rows[first[fits]]] = token[first[fits]]
                token[first] = -1
                left = left[(last[end, row] < 0) & (token[left] >= 0)]
            if (last[end, :n] < 0).any():
                raise ValueError(f"no token ends at byte {end}")
        counts, steps, left = np.zeros(len(pieces), np.int64), [], np.arange(len(short))
        at = size.copy()
        while len(left := left[at[left] > 0]):
            token = last[at[left], left]
            steps.append((left, token))
            at[left] -= self.lengths[token]
            counts[short[left]] += 1
        long = {int(i): self.encode_piece(pieces[i]) for i in order[: len(order) - len(short)]}
        for i, ids in long.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        flat, to = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32), ends.copy()
        for left, token in steps:
            to[short[left]] -= 1
            flat[to[short[left]]] = token
        for i, ids in long.items():
            flat[ends[i] - len(ids) : ends[i]] = ids
        return flat, counts

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The encoding of one piece that grows at the end and changes in the middle."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, end, self.last))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for data[start:stop]; returns how many prefixes were computed."""
        old, shift, work = self.last, len(new) - (stop - start), 0
        self.data = self.data[:start] + new + self.data[stop:]
        last, agree, edge = old[: start + 1], 0, start + len(new)
        for end in range(start + 1, len(self.data) + 1):
            if agree >= self.vocabulary.longest:
                last.extend(old[end - shift :])
                break
            token = self.vocabulary.last_token(self.data, end, last)
            last.append(token)
            work += 1
            agree = agree + 1 if end > edge and old[end - shift] == token else 0
        self.last = last
        return work

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


class Encoder(dict):
    """Text to ids: the pattern's matches one by one, each by the prefix table. Numbers the pieces it has met and keeps their ids."""

    _cut = re.compile(r"(?<=[^\s\x00-\x20]) (?=[^\s\x00-\x20])")

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        at = self[piece] = len(self)
        return at

    def _learn(self) -> None:
        for at in range(0, len(self.new), NEW_PIECES):
            flat, counts = self.vocabulary.encode_pieces([p.encode("utf-8", "surrogatepass") for p in self.new[at : at + NEW_PIECES]])
            self.flat.append(flat)
            self.counts.append(counts)
        self.new = []

    def pieces(self, text: str):
        """Lists of matches, over blocks that end where a lone space starts the next match."""
        at = 0
        while at < len(text):
            cut = self._cut.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            to = cut.start() if cut else len(text)
            yield self.split.findall(text[at:to] if at or cut else text)
            at = to

    def _ids(self, numbers: list[np.ndarray], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        self._learn()
        self.flat, self.counts = [np.concatenate(self.flat)], [np.concatenate(self.counts)]
        of, counts = np.concatenate(numbers or [np.zeros(0, np.int32)]), self.counts[0]
        stops = np.r_[0, np.cumsum(counts[of])]
        first = (np.cumsum(counts) - counts)[of]
        ids = self.flat[0][np.repeat(first - stops[:-1], counts[of]) + np.arange(stops[-1])]
        return ids, stops[ends]

    def encode_texts(self, texts):
        """(ids of some texts one after the other, where each ends), block by block, until all texts are told."""
        if len(self) > CACHE_PIECES:
            self._forget()
        numbers, held, ends = [], 0, []
        for text in texts:
            for found in self.pieces(text):
                numbers.append(np.fromiter(map(self.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if len(self.new) >= NEW_PIECES:
                    self._learn()
            ends.append(held)
            if held >= BLOCK_PIECES:
                yield self._ids(numbers, ends)
                if len(self) > CACHE_PIECES:
                    self._forget()
                numbers, held, ends = [], 0, []
        if ends:
            yield self._ids(numbers, ends)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_texts([text]))[0].tolist()


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker for each vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)``: each row's whole text as token ids, without special tokens.

    A null or empty text has no ids. A row is encoded on its own, so ties,
    repeated rows and null doc_ids change nothing; other columns are not read.
    """

    def run(batches):
        own = encoder(path, pattern)
        for b in batches:
            at = 0
            for ids, ends in own.encode_texts(x.as_py() for x in b.column(1)):
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ends)), listed], ["doc_id", "ids"])
                at += len(ends)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` → ``(doc_id, ids, decoded)``: the bytes the ids stand for. Null ids: no bytes."""

    def run(batches):
        tokens = np.array(encoder(path, pattern).vocabulary.tokens, dtype=object)
        for b in batches:
            ids = b.column(1)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            made = [b"".join(tokens[flat[s:e]]) for s, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(made, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    full = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return full.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from the ids and bytes that the two operators give."""
    done = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
