"""Language identification with a linear-chain conditional random field.

Every word gets a label. Emissions come from hashed affix, character n-gram and
lexicon features of the word; transitions between labels are learned too.
Forward-backward gives each word's posterior, so code-switched text is labelled
word by word; a document's language is the one with the largest posterior mass.

Training reads a bounded, documented sample: about SAMPLE_ROWS rows for each
label, of longer texts SAMPLE_CHARS code points from a random place. All labels
are learned; more than LABELS are an error, never left out. Sequences
are cut from them at random and strung together across languages, so the
transitions see switches. Prediction reads every whole text.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample and the model.
SAMPLE_ROWS, LABELS, SAMPLE_CHARS = 300, 256, 20_000
SEQUENCES, LENGTH, ROUNDS = 3000, 48, 40
#: Labels that SEQUENCES do for; more labels get more of them, handled in as many parts.
SEQUENCE_LABELS = 64
BUCKET_BITS, LEXICON = 16, 200
BUCKETS = 1 << BUCKET_BITS
#: Words a worker remembers, scores at once, and that one block of forward-backward holds.
CACHE_WORDS, SCORE_WORDS, BLOCK_WORDS = 250_000, 100_000, 200_000
#: New words whose features are taken side by side.
NEW_WORDS = 10_000
#: Odd factors of the feature hashes.
MIX = np.random.default_rng(42).integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


#: Letters and marks of one position of the chain; a longer word takes several.
PIECE = 40


def words_of(text: str) -> list[str]:
    """The words of a text, one of more than PIECE letters in pieces."""
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature buckets of whole words: (whose, bucket) pairs in no order.

    A word stands between ^ and $. It has its first and last 2, 3 and 4 letters,
    all runs of 1, 2 and 3 letters and, if the lexicon lists it, itself.
    """
    lengths = np.array([len(w) + 2 for w in words])
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    everyone = np.arange(len(words))
    owner = np.repeat(everyone, lengths)
    rest = np.repeat(starts + lengths, lengths) - np.arange(flat.size)
    runs = [flat + np.uint64(1)]  # runs[k - 1] has at each place the hash of the k letters from there
    for k in range(1, 4):
        runs.append(runs[-1].copy())
        runs[-1][:-k] = runs[-1][:-k] * MIX[0] + flat[k:]
    whose, hashes = [], []
    for k in (1, 2, 3):
        fits = rest >= k
        whose.append(owner[fits])
        hashes.append(runs[k - 1][fits] * MIX[1])
    runs = np.stack(runs)
    for k in (2, 3, 4):
        width = np.minimum(k, lengths)
        for mix, at in ((MIX[2], starts), (MIX[3], starts + lengths - width)):
            whose.append(everyone)
            hashes.append(runs[width - 1, at] * mix)
    whose, bucket = np.concatenate(whose), (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    listed = [(i, w) for i, w in enumerate(words) if w in lexicon]
    own = [zlib.crc32(f"l{w}".encode("utf-8", "surrogatepass")) % BUCKETS for _, w in listed]
    at = np.array([i for i, _ in listed], np.int64)
    return np.concatenate([whose, at, at]), np.concatenate([bucket, np.array(own, np.int64), np.full(at.size, zlib.crc32(b"l") % BUCKETS)])


def word_scores(whose: np.ndarray, bucket: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Scores by word and label: a word's summed feature weights over the square root of their number. ``weights``: label by bucket."""
    scale = np.maximum(np.bincount(whose, minlength=n), 1) ** -0.5
    return np.stack([np.bincount(whose, row[bucket], n) * scale for row in weights], axis=1)


class Numbered(dict):
    """Numbers for words in the order they are met; ``new`` lists those not yet scored."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at


class Model:
    def __init__(self, labels: list[str], lexicon: frozenset[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.labels, self.lexicon, self.weights, self.moves, self.start = labels, lexicon, weights, moves, start
        self._forget()

    def __getstate__(self):
        return {"labels": self.labels, "lexicon": self.lexicon, "weights": self.weights, "moves": self.moves, "start": self.start}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self._rows, self._table = Numbered(), np.zeros((0, len(self.labels)), np.float32)

    def _learn(self) -> None:
        new, self._rows.new = self._rows.new, []
        scores = [self._table]
        for at in range(0, len(new), NEW_WORDS):
            some = new[at : at + NEW_WORDS]
            scores.append(word_scores(*features(some, self.lexicon), self.weights, len(some)).astype(np.float32))
        self._table = np.concatenate(scores)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores by word and label."""
        return self._emissions([words])[0]

    def _emissions(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self._rows) > CACHE_WORDS:
            self._forget()
        of = self._rows.__getitem__
        rows = [np.fromiter(map(of, t), np.int32, len(t)) for t in texts]
        self._learn()
        return [self._table[at] for at in rows]

    def posterior_mass(self, texts) -> np.ndarray:
        """The sum of word posteriors of each text, a list of words, by label; zeros for one without words.

        Texts of about one length are handled side by side, as a step of
        forward-backward takes one word of each.
        """
        out: dict[int, np.ndarray] = {}
        pools: dict[int, list[tuple[int, np.ndarray]]] = {}
        sizes: dict[int, int] = {}
        waiting, held = [], 0

        def flush(size: int):
            pool = pools.pop(size, [])
            sizes.pop(size, 0)
            for (i, _), mass in zip(pool, self._sums([e for _, e in pool])):
                out[i] = mass

        def score():
            for (i, _), e in zip(waiting, self._emissions([w for _, w in waiting])):
                size = len(e).bit_length()
                pools.setdefault(size, []).append((i, e))
                sizes[size] = sizes.get(size, 0) + len(e)
                if sizes[size] >= BLOCK_WORDS:
                    flush(size)
            waiting.clear()

        n = 0
        for n, words in enumerate(texts, 1):
            if words:
                waiting.append((n - 1, words))
                held += len(words)
                if held >= SCORE_WORDS:
                    score()
                    held = 0
        score()
        for size in list(pools):
            flush(size)
        zero = np.zeros(len(self.labels))
        return np.stack([out.get(i, zero) for i in range(n)]) if n else np.zeros((0, len(self.labels)))

    def _sums(self, scores: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(t) for t in scores])
        posterior = forward_backward(np.concatenate(scores), lengths, self.moves, self.start)
        return np.add.reduceat(posterior, np.cumsum(lengths) - lengths, axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Word posteriors of concatenated sequences. One step handles the t-th word of all sequences that have one."""
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths)
    begin = (ends - lengths)[order]
    sizes = lengths[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    step = np.exp(moves)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    ahead = np.empty_like(emit)
    state = np.exp(start)[None, :] * np.ones((len(sizes), 1))
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        state = (state[:n] @ step if t else state[:n]) * emit[at]
        state /= state.sum(axis=1, keepdims=True)
        ahead[at] = state
    back = np.ones((0, emit.shape[1]))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        if len(back) < n:  # sequences whose last word this is
            back = np.concatenate([back, np.ones((n - len(back), emit.shape[1]))])
        ahead[at] *= back
        back = (back * emit[at]) @ step.T
        back /= back.sum(axis=1, keepdims=True)
    ahead /= ahead.sum(axis=1, keepdims=True)
    return ahead


def pair_expectation(scores: np.ndarray, count: int, length: int, moves: np.ndarray, start: np.ndarray):
    """Posteriors and expected transition counts of ``count`` sequences of equal length."""
    k = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64).reshape(count, length, k)
    step = np.exp(moves)
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    state = np.exp(start)[None, :] * emit[:, 0]
    ahead[:, 0] = state / state.sum(axis=1, keepdims=True)
    for t in range(1, length):
        state = (ahead[:, t - 1] @ step) * emit[:, t]
        ahead[:, t] = state / state.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        state = (back[:, t + 1] * emit[:, t + 1]) @ step.T
        back[:, t] = state / state.sum(axis=1, keepdims=True)
    posterior = ahead * back
    posterior /= posterior.sum(axis=2, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(1, length):
        after = back[:, t] * emit[:, t]
        whole = ((ahead[:, t - 1] @ step) * after).sum(axis=1, keepdims=True)
        expected += step * ((ahead[:, t - 1] / whole).T @ after)
    return posterior.reshape(-1, k), expected


def train(samples: list[tuple[str, list[str]]], seed: int = 1, sequences: int = SEQUENCES, length: int = LENGTH, rounds: int = ROUNDS) -> Model:
    """A model from (label, words) pairs, by gradient ascent on the likelihood of strung-together sequences."""
    labels = sorted({label for label, words in samples if words})
    if not labels:
        return Model([UNKNOWN], frozenset(), np.zeros((1, BUCKETS), np.float32), np.zeros((1, 1)), np.zeros(1))
    rnd = np.random.default_rng(seed)
    pool = {label: [w for who, w in samples if who == label and w] for label in labels}
    common: set[str] = set()
    for label in labels:
        seen: dict[str, int] = {}
        for words in pool[label]:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
        common |= {w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    lexicon = frozenset(common)
    words, gold = [], []
    sequences = max(sequences, sequences * len(labels) // SEQUENCE_LABELS)
    for _ in range(sequences):
        row: list[str] = []
        while len(row) < length:
            k = int(rnd.integers(len(labels)))
            source = pool[labels[k]][int(rnd.integers(len(pool[labels[k]])))]
            n = int(rnd.integers(8, length + 1))
            at = int(rnd.integers(max(1, len(source) - n + 1)))
            part = source[at : at + n][: length - len(row)]
            row += part
            gold += [k] * len(part)
        words += row
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([names[w] for w in words])
    owner, bucket = features(list(names), lexicon)
    scale = np.bincount(owner, minlength=len(names)) ** -0.5
    k, gold = len(labels), np.array(gold)
    parts = np.array_split(np.arange(sequences), (-(-k // SEQUENCE_LABELS)) ** 2)
    pairs = gold.reshape(-1, length)
    seen = np.zeros((k, k))
    np.add.at(seen, (pairs[:, :-1].ravel(), pairs[:, 1:].ravel()), 1)
    weights, moves, start = np.zeros((k, BUCKETS)), np.zeros((k, k)), np.zeros(k)
    memory = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(rounds):
        value = word_scores(owner, bucket, weights, len(names))
        by_word, expected = np.zeros((len(names), k)), np.zeros((k, k))
        for part in filter(len, parts):
            own = slice(part[0] * length, (part[-1] + 1) * length)
            posterior, pair = pair_expectation(value[at[own]], len(part), length, moves, start)
            slope = (np.eye(k)[gold[own]] - posterior) / len(at)
            by_word += np.stack([np.bincount(at[own], slope[:, j], len(names)) for j in range(k)], axis=1) * scale[:, None]
            expected += pair
        grads = [
            np.stack([np.bincount(bucket, by_word[owner, j], BUCKETS) for j in range(k)]) - 1e-7 * weights,
            (seen - expected) / len(at) - 1e-7 * moves,
        ]
        for x, g, m in zip((weights, moves), grads, memory):  # AdaGrad
            m += g * g
            x += 0.3 * g / (np.sqrt(m) + 1e-9)
    return Model(labels, lexicon, weights.astype(np.float32), moves, start)


def training_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, list[str]]]:
    """(label, words) of about ``rows`` rows for each label, chosen by hash. Raises if there are more than LABELS labels."""
    usable = labelled.where("lang is not null and text is not null")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS + 1).collect()
    if len(counts) > LABELS:
        raise ValueError(f"more than {LABELS} languages to learn")
    if not counts:
        return []
    share = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.lit(min(1.0, rows / r["count"]))) for r in counts))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    over = F.length("text") - SAMPLE_CHARS
    at = F.when(over > 0, F.pmod(F.xxhash64(F.lit("cut"), "doc_id"), over.cast("long") + 1)).otherwise(F.lit(0)).cast("int") + 1
    chosen = (
        usable.where(place < share[F.col("lang")])
        .select("lang", F.col("text").substr(at, F.lit(SAMPLE_CHARS)).alias("text"), (over > 0).alias("cut"), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text")
    )
    return [(r["lang"], _whole_words(words_of(r["text"]), r["cut"])) for r in chosen.limit(2 * rows * len(counts)).collect()]


def _whole_words(words: list[str], cut: bool) -> list[str]:
    """The words of a text without those that a cut may have split."""
    return words[1:-1] if cut and len(words) > 2 else words


def held_out(doc_id):
    """The rows no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)``: the label with the largest posterior mass over the words of the whole text, and its share.

    ``und`` with score 0 if the text is null or has no letter. Texts are
    labelled one by one: ties, repeated rows and null doc_ids change nothing;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels floats, whatever the corpus

    def run(batches):
        own = shared.value
        for b in batches:
            mass = own.posterior_mass(words_of(x.as_py() or "") for x in b.column(1))
            total = mass.sum(axis=1)
            told = total > 0
            labels = pa.array(np.where(told, np.array(own.labels, object)[mass.argmax(axis=1)], UNKNOWN), pa.string())
            scores = np.where(told, mass.max(axis=1) / np.maximum(total, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), labels, pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row, by a model of the rows that are not held out.

    Null, empty and letterless texts are ``und`` with score 0, as are all if no
    row has a label to learn. Repeated rows and null doc_ids (not held out) are
    judged by their texts; other columns are not read; no rows give no rows.
    """
    model = train(training_sample(docs.where(~held_out(F.col("doc_id")))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: A document goes if no letter speaks for a language, or if no language has this share of its words.
MIN_SHARE = 0.4


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language cannot be told: null, empty and letterless texts, and those under MIN_SHARE.

    Without a label to learn all letters speak for one unknown language, and
    texts with letters stay. Repeated rows and null doc_ids are judged by their
    own texts; columns stay as they are; no rows give no rows.
    """
    model = train(training_sample(docs.where(~held_out(F.col("doc_id")))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(texts: pa.Array) -> pa.Array:
        mass = shared.value.posterior_mass(words_of(x.as_py() or "") for x in texts)
        total = mass.sum(axis=1)
        return pa.array((total > 0) & (mass.max(axis=1) >= MIN_SHARE * total))

    return docs.where(F.arrow_udf(told, "boolean")(F.col("text").cast("string")))
