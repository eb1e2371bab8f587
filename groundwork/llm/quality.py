"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word falls into one of ``BUCKETS`` rows by hash and has a sparse ternary index vector there. Its
word vector is the sum, over all its occurrences in the whole corpus, of its neighbours' index vectors.
The shape of a word (runs of upper case, lower case, digits; other characters as they are) and three
marks for repetition are words of a second kind that keep their own index vectors. A document is the
mean of its word vectors, the mean of its shape and mark vectors, and its log length.

The network (tanh layer, logistic output) learns from a bounded sample of labelled rows, by numpy on the
driver; one part of the sample sets the temperature by which its logits are divided.

Plan: one pass sums neighbour vectors (integers, so the order of addition does not matter): per task at
most ``BUCKETS`` rows, then an aggregate by bucket to ``BUCKETS`` rows in all, whatever the input. The
sample's labels (at most ``SAMPLE`` rows) are broadcast to the pass that makes its features. The last
pass scores. Texts are read three times and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, in_arrow

BITS, DIM, MARK_DIM, NONZERO, WINDOW = 13, 32, 64, 4, 2
BUCKETS = 1 << BITS
SAMPLE = 20_000
FEATURES = DIM + MARK_DIM + 1
THRESHOLD = 0.7
_CACHE_WORDS = 1 << 18
_SLICE = 1 << 18
_SAME, _SEEN, _LINE = 0, 1, 2  # rows of the marks in the second table


def index_vectors(dim: int, seed: int) -> np.ndarray:
    """A sparse ternary vector per bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, dim), dtype=np.int8)
    at = np.argsort(rng.random((BUCKETS, dim)), axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], at] = rng.choice(np.array([-1, 1], dtype=np.int8), (BUCKETS, NONZERO))
    return out


_KINDS = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c
    for c in range(256)
)
_RUNS = re.compile(rb"([aA9])\1+")


def shape(word: bytes) -> bytes:
    """Runs of upper case, lower case (with all non-ASCII letters) and digits as one A, a, 9; the rest as it is."""
    return _RUNS.sub(rb"\1", word.translate(_KINDS))


_codes: dict[bytes, int] = {}


def _code(word: bytes) -> int:
    """Word bucket and shape bucket of a word as written, in one number."""
    if len(_codes) > _CACHE_WORDS:
        _codes.clear()
    w = xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS
    s = 3 + xxhash.xxh3_64_intdigest(shape(word)) % (BUCKETS - 3)
    _codes[word] = c = (w << BITS) + s
    return c


def word_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    codes = list(map(_codes.get, words))
    if None in codes:
        codes = [_code(w) if c is None else c for w, c in zip(words, codes, strict=True)]
    c = np.array(codes, dtype=np.int64)
    return c >> BITS, c & (BUCKETS - 1)


def repeated_lines(text: bytes) -> int:
    """Words in lines that have stood in the text before."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += len(line.split())
        elif line.strip():
            seen.add(line)
    return n


def features(text: bytes, vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    w, s = word_codes(text)
    n = len(w)
    out = np.zeros(FEATURES)
    out[-1] = math.log1p(n)
    if n:
        kinds, times = np.unique(w, return_counts=True)
        distinct = len(kinds)
        out[:DIM] = times @ vectors[kinds] / n
        kinds, times = np.unique(s, return_counts=True)
        pooled = times @ marks[kinds]
        pooled = pooled + int((w[1:] == w[:-1]).sum()) * marks[_SAME].astype(float)
        pooled = pooled + (n - distinct) * marks[_SEEN].astype(float)
        pooled = pooled + repeated_lines(text) * marks[_LINE].astype(float)
        out[DIM:-1] = pooled / n
    return out


class NeighbourSums:
    """Sums of neighbours' index vectors by word bucket, over up to ``WINDOW`` words on either side.

    An index vector has few non-zero places, so each neighbour adds its signs at those places only. Texts
    are joined by empty words (number ``BUCKETS``, signs 0) that no window reaches across.
    """

    def __init__(self) -> None:
        index = index_vectors(DIM, 41)
        row, place = np.nonzero(index)
        self.place = np.vstack([place.reshape(BUCKETS, NONZERO), np.zeros((1, NONZERO), int)]).T.copy()
        self.sign = np.hstack([index[row, place].reshape(BUCKETS, NONZERO).T, np.zeros((NONZERO, 1))]).astype(float)
        self.sums = np.zeros((BUCKETS + 1) * DIM)
        self.met = np.zeros(BUCKETS + 1, dtype=bool)

    def add(self, texts: list[np.ndarray]) -> None:
        gap = np.full(WINDOW, BUCKETS)
        words = np.concatenate([x for t in texts for x in (t, gap)])
        self.met[words] = True
        for d in range(1, WINDOW + 1):
            left, right = words[:-d], words[d:]
            for own, near in ((left, right), (right, left)):
                for k in range(NONZERO):
                    at = own * DIM + self.place[k][near]
                    self.sums += np.bincount(at, self.sign[k][near], len(self.sums))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets met and their sums (whole numbers)."""
        met = np.flatnonzero(self.met[:BUCKETS])
        return met, self.sums.reshape(-1, DIM)[met].astype(np.int64)


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = NeighbourSums()
    texts, n = [], 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            w = word_codes(text.as_py() or b"")[0]
            if len(w):
                texts.append(w)
                n += len(w)
            if n >= _SLICE:
                total.add(texts)
                texts, n = [], 0
    if texts:
        total.add(texts)
    met, sums = total.rows()
    columns = [pa.array(met.astype(np.int32))] + [pa.array(sums[:, d]) for d in range(DIM)]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"c{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets, from neighbours over the whole corpus."""
    schema = ", ".join(["bucket int", *(f"c{d} long" for d in range(DIM))])
    parts = in_arrow(docs.select(text_col), _context, schema)
    total = parts.groupBy("bucket").agg(*(F.sum(f"c{d}").alias(f"c{d}") for d in range(DIM))).toPandas()
    out = np.zeros((BUCKETS, DIM))
    if len(total):
        out[total["bucket"].to_numpy()] = total[[f"c{d}" for d in range(DIM)]].to_numpy()
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, with targets drawn in by one row of each kind (Platt's), so that it is
    finite also where the logits part the labels without an error. Logits that rank the labels the wrong way, or are
    all zero, keep 1."""
    positive = float(y.sum())
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))

    def slope(inverse: float) -> float:  # of the loss, by 1 / temperature; it only rises
        return float(np.mean(z * (1 / (1 + np.exp(-np.clip(inverse * z, -60, 60))) - target)))

    if not np.any(z) or slope(0.0) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while slope(high) < 0:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    return 1 / high


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Network:
    """Two layers by Adam on four fifths of the rows; the last fifth chooses the temperature (with under 50 rows: all rows do
    both, as a fifth would be too few)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit_rows, cal = (order, order) if len(y) < 50 else np.split(order, [len(y) * 4 // 5])
    a, t = x[fit_rows], y[fit_rows].astype(float)
    net = Network(
        a.mean(axis=0), a.std(axis=0) + 1e-6,
        rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
        rng.normal(0, 1 / math.sqrt(hidden), hidden), float(np.log((t.mean() + 1e-3) / (1.001 - t.mean()))),
    )
    a = (a - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        mix = rng.permutation(len(t))
        for i in range(0, len(t), 128):
            rows = mix[i : i + 128]
            h = np.tanh(a[rows] @ params[0] + params[1])
            err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - t[rows]) / len(rows)
            back = np.outer(err, params[2]) * (1 - h * h)
            grads = [a[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ err + 1e-4 * params[2], np.array([err.sum()])]
            step += 1
            for p, g, m1, v1 in zip(params, grads, m, v, strict=True):
                m1 *= 0.9
                m1 += 0.1 * g
                v1 *= 0.999
                v1 += 0.001 * g * g
                p -= 0.003 * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    z = net.logits(x[cal])
    net.temperature = temperature(z, y[cal])
    return net


def training_fold(id_col: str, folds: int = 4, held: int = 2):
    """True for rows from which labels may be learnt."""
    return F.crc32(id_text(id_col).cast("binary")) % folds != held


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[np.ndarray, Network | float]:
    """Word vectors of ``docs`` and the network. Without labelled rows of both kinds: a constant score.

    At most ``sample`` labelled rows of the training fold are used, those with the smallest id hashes; of rows that repeat
    such an id, the text with the smallest hash is the labelled one.
    """
    vectors = word_vectors(docs, text_col)
    chosen = (
        labels.where(training_fold(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(sample)
    )
    marks = index_vectors(MARK_DIM, 43)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py() or b"", vectors, marks) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    # the chosen rows are at most `sample` small ones, so they may be broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    # one text for each chosen label, whatever number of rows repeats its id: at most `sample` rows are brought to the driver
    rows = rows.groupBy("__id", "__label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = in_arrow(rows.select(F.col("__label").alias("y"), "text"), run, "y int, x array<double>")
    got = sorted(got.toArrow().to_pylist(), key=lambda r: (r["x"], r["y"]))
    y = np.array([r["y"] for r in got], dtype=int)
    if len(set(y.tolist())) < 2:
        return vectors, 1.0 if not len(y) else float((y.sum() + 0.5) / (len(y) + 1))
    return vectors, fit(np.array([r["x"] for r in got]), y)


def score(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``quality_held_out, quality_score, quality_predicted`` (1 if the score reaches ``threshold``).

    Scores lie in 0..1. Null and empty texts are documents without words and are scored too. Rows whose
    id is in the held-out fold (a null id counts as the empty text) never lend a label. Repeated ids are
    scored one by one; a repeated id in ``labels`` lends each of its labels. With no labelled row every
    score is 1, so nothing is rejected unseen. Columns of these three names are replaced.
    """
    added = ("quality_held_out", "quality_score", "quality_predicted")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    vectors, net = train(docs, labels, sample, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        marks = index_vectors(MARK_DIM, 43)
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(at).cast(pa.binary())]
            if isinstance(net, float):
                s = np.full(len(texts), net)
            else:
                s = net.scores(np.array([features(t, vectors, marks) for t in texts]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "quality_score"])

    scored = in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))
    return scored.withColumn("quality_held_out", ~training_fold(id_col)).withColumn(
        "quality_predicted", (F.col("quality_score") >= threshold).cast("int")
    )
