"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on windows typical of toxic text, the other on
windows of ordinary text. A window, one word between its bounds behind a fixed
carrier that both dictionaries hold, is compressed with either; the margin is
how many bytes the toxic dictionary saves. (Without the carrier zstandard
stores short windows uncompressed and every margin is 0.) Windows over several
calibrated thresholds are counted over the whole text, and a logistic curve
turns the counts into a score, shifted so that the best cut lies at 0.7.

Training reads a bounded, documented sample of labelled rows. The curve is
fitted across two halves of it, each scored with dictionaries of the other.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample and the dictionaries.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 1500, 3000, 20_000
TOXIC_BYTES, ORDINARY_BYTES, ORDINARY_WINDOWS = 16 << 10, 64 << 10, 150_000
#: A window is typical of toxic text if so many toxic rows have it, and so much more often than ordinary rows.
LEAST_ROWS, LEAST_RATIO = 4, 8.0
#: Windows of either kind below which no dictionary is trained and all scores are 0.
LEAST_WINDOWS = 40
MARGINS = (2, 3, 4, 5, 6, 7)
LEVEL, CUT = 16, 0.7
CACHE_WORDS, BLOCK_WORDS = 400_000, 400_000
CARRIER = b"QZ7!kw#Vx2@Jp9%Lm4&Tg6*Ys8(Hd3)b"
WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window(word: str) -> bytes:
    return CARRIER + b"\n" + word.encode("utf-8", "surrogatepass") + b"\n"


def train_dictionary(windows: list[bytes], size: int) -> bytes:
    """Dictionary bytes for at least LEAST_WINDOWS windows; ``zstandard.ZstdError`` if none can be trained."""
    return zstandard.train_dictionary(size, windows, level=LEVEL).as_bytes()


def _compressor(dictionary: bytes):
    options = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=options).compress


class Model:
    """Two dictionaries and the curve; picklable, with compressors made where it is used."""

    def __init__(self, toxic: bytes, ordinary: bytes, curve: np.ndarray | None = None):
        self.toxic, self.ordinary, self.curve = toxic, ordinary, curve
        self._margins: dict[str, int] = {}
        self._pair = None

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "curve": self.curve, "_margins": {}, "_pair": None}

    def margin(self, word: str) -> int:
        if self._pair is None:
            self._pair = _compressor(self.toxic), _compressor(self.ordinary)
        if len(self._margins) >= CACHE_WORDS:
            self._margins.clear()
        w = window(word)
        found = len(self._pair[1](w)) - len(self._pair[0](w))
        if len(word) < 64:
            self._margins[word] = found
        return found

    def counts(self, texts: list[list[str]]) -> np.ndarray:
        """Per text: how many windows reach each margin, and how many words there are."""
        get, add = self._margins.get, self.margin
        flat = np.array([m if (m := get(w)) is not None else add(w) for w in chain.from_iterable(texts)], np.int32)
        ends = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        out = np.zeros((len(texts), len(MARGINS) + 1))
        for j, m in enumerate(MARGINS):
            total = np.r_[0, np.cumsum(flat >= m)]
            out[:, j] = total[ends[1:]] - total[ends[:-1]]
        out[:, -1] = np.diff(ends)
        return out

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(features(self.counts(texts)) @ self.curve, -40, 40)))


def features(counts: np.ndarray) -> np.ndarray:
    """Logs of the counts and of the counts by length, and a constant."""
    n = counts[:, -1:]
    hits = counts[:, :-1]
    return np.concatenate([np.log1p(hits), np.log1p(100 * hits / np.maximum(n, 1)), np.log1p(n) / 5, np.ones((len(counts), 1))], axis=1)


def fit_dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> Model | None:
    in_toxic, in_ordinary = (Counter(chain.from_iterable(map(set, part))) for part in (toxic, ordinary))
    least = max(LEAST_ROWS, len(toxic) // 200)
    typical = {
        w for w, n in in_toxic.items() if n >= least and n / len(toxic) >= LEAST_RATIO * (in_ordinary[w] + 0.5) / max(1, len(ordinary))
    }
    if not typical:
        return None
    marked = [window(w) for t in toxic for w in t if w in typical]
    plain = list(chain.from_iterable(ordinary))
    if min(len(marked), len(plain)) < LEAST_WINDOWS:
        return None
    step = max(1, len(plain) // ORDINARY_WINDOWS)
    return Model(train_dictionary(marked, TOXIC_BYTES), train_dictionary([window(w) for w in plain[::step]], ORDINARY_BYTES))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> np.ndarray:
    """Logistic coefficients by Newton steps, then shifted so that the cut with the best F1 scores CUT."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    order = np.argsort(-(x @ b), kind="stable")
    z, hit = (x @ b)[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    cut = z[best] if best + 1 == len(z) else (z[best] + z[best + 1]) / 2
    b[-1] += np.log(CUT / (1 - CUT)) - cut
    return b


def train(samples: list[tuple[int, list[str]]]) -> Model:
    """A model from (label, words) pairs; one that scores 0 throughout if a label or LEAST_WINDOWS typical windows are missing."""
    halves, ys, xs = [samples[0::2], samples[1::2]], [], []
    split = lambda part, label: [w for y, w in part if y == label]
    model = fit_dictionaries(split(samples, 1), split(samples, 0)) if split(samples, 1) and split(samples, 0) else None
    if model is None:
        return Model(b"", b"")
    for mine, other in (halves, halves[::-1]):
        half = fit_dictionaries(split(other, 1), split(other, 0)) if split(other, 1) and split(other, 0) else None
        xs.append(features((half or model).counts([w for _, w in mine])))
        ys.append([y for y, _ in mine])
    model.curve = fit_curve(np.concatenate(xs), np.concatenate(ys).astype(float))
    return model


def held_out(doc_id):
    """The rows no model learns from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> list[tuple[int, list[str]]]:
    """(label, words) of about so many labelled rows, of long ones a piece, chosen by hash; held-out rows never come in."""
    known = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, most / max(1, sizes.get(y, 0))) for y, most in ((1, toxic_rows), (0, ordinary_rows))}
    place = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    bound = 2 * (toxic_rows + ordinary_rows)
    chosen = known.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # of a longer text SAMPLE_CHARS code points from a place that its hash picks
    whole, spare = F.col("text").cast("string"), F.length(F.col("text").cast("string")) - SAMPLE_CHARS
    start = F.when(spare > 0, F.pmod(F.xxhash64(F.lit("piece"), "doc_id", whole), spare + 1)).otherwise(F.lit(0)).cast("int") + 1
    texts = docs.select("doc_id", F.substring(whole, start, F.lit(SAMPLE_CHARS)).alias("text")).where("text is not null")
    # at most ``bound`` ids are broadcast, so no text is shuffled
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(bound)
    return [(int(r["toxic"]), words_of(r["text"])) for r in rows.collect()]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of each row's whole text; null counts as empty.

    Rows are scored one by one: ties, repeated rows and null doc_ids change
    nothing; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TOXIC_BYTES + ORDINARY_BYTES

    def flush(ids, texts):
        return pa.RecordBatch.from_arrays([ids, pa.array(shared.value.scores(texts), pa.float64())], ["doc_id", "score"])

    def run(batches):
        for b in batches:
            texts, held, at = [], 0, 0
            for i, x in enumerate(b.column(1)):
                texts.append(words_of(x.as_py() or ""))
                held += len(texts[-1])
                if held >= BLOCK_WORDS:
                    yield flush(b.column(0).slice(at, i + 1 - at), texts)
                    texts, held, at = [], 0, i + 1
            if texts:
                yield flush(b.column(0).slice(at), texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row, by a model of the labelled rows that are not held out.

    Null counts as empty. With too little to learn from (see ``train``) all
    scores are 0. Of several labels of a doc_id the largest counts; labels
    without doc_id are not learned. Repeated rows and null doc_ids (not held
    out) are scored by their texts; other columns are not read; no rows give no
    rows.
    """
    scored = predict(docs, train(training_sample(docs, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
