"""Quality classifier: random-indexing word vectors, pooled by document, then a two-layer network with calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, groups, held, ready, spread, sums_by, table
from .scoring import in_order, labelled, scored

#: Components of a word vector; non-zero ones of an index vector; words to either side that are its context.
WIDTH, MARKS, WINDOW = 32, 6, 2
#: Words are told apart by this many hash values (16 bits), so that the vectors' size doesn't grow with the corpus (8 MB); hash values that are sent together.
BUCKETS, CHUNK = 1 << 16, 64
HIDDEN, EXTRA = 32, 9
#: Labelled rows that the network learns from.
SAMPLE_ROWS = 6000


#: Of the words' hashes, which are polynomials in BASE of their bytes, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_MIX = 0xBF58476D1CE4E5B9
_powers: dict[int, np.ndarray] = {}

_BYTES = np.arange(256)
SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
UPPER, LOWER, DIGIT = ((_BYTES >= lo) & (_BYTES <= hi) for lo, hi in ((65, 90), (97, 122), (48, 57)))
LETTER, REST = UPPER | LOWER | (_BYTES >= 192), (_BYTES >= 128) & (_BYTES < 192)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), base, np.uint64)])
    return _powers[base][:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each part of the bytes, by sums of all bytes up to a place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=upto[1:])
    h = (upto[ends] - upto[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(_MIX)
    return h ^ (h >> np.uint64(32))


class Tokens:
    """The words (runs without ASCII white space) of some texts: `part` is a word's text, `bucket` its hash value below BUCKETS."""

    def __init__(self, parts: list[str]):
        raw = [p.encode("utf-8", "replace") for p in parts]
        self.data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        self.ends_of = np.cumsum([len(r) + 1 for r in raw])
        blank = np.r_[True, SPACE[self.data]]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.part = np.searchsorted(self.ends_of, self.starts, "right")
        self.hash = hashes(self.data, self.starts, self.ends)
        self.bucket = (self.hash >> np.uint64(48)).astype(np.uint16)

    def count(self, kind: np.ndarray) -> np.ndarray:
        """How many bytes of a kind each word has."""
        upto = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(kind[self.data], out=upto[1:])
        return upto[self.ends] - upto[self.starts]

    def surface(self) -> np.ndarray:
        """EXTRA features of each word."""
        letters, upper, digits = (self.count(k) for k in (LETTER, UPPER, DIGIT))
        size = self.ends - self.starts - self.count(REST)
        other = size - letters - digits
        first = UPPER[self.data[self.starts]] if len(self.starts) else np.zeros(0, bool)
        columns = [letters > 0, letters / np.maximum(size, 1), (size > 1) & (upper == letters) & (letters > 0), digits > 0, other > 0, np.minimum(size, 40) / 10, size > 20, letters == 0, first]
        return np.stack(columns, axis=1).astype(np.float32)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The text and the hash of each line."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.r_[0, ends[:-1] + 1].astype(np.int64)[: len(ends)]
        return np.searchsorted(self.ends_of, starts, "right"), hashes(self.data, starts, ends)


def distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])][: len(h)]
    return np.bincount(owner[new], minlength=n)


def index_vectors() -> np.ndarray:
    """The fixed sparse vector of each hash value: MARKS places get +1 or -1, by a hash."""
    out = np.zeros((BUCKETS, WIDTH), np.int8)
    own = np.arange(BUCKETS, dtype=np.uint64)
    for k in range(MARKS):
        h = (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * k + 1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        np.add.at(out, (own.astype(np.int64), (h >> np.uint64(8)).astype(np.int64) % WIDTH), np.where(h & np.uint64(1), 1, -1).astype(np.int8))
    return out


def add_contexts(sums: np.ndarray, words: np.ndarray, part: np.ndarray, index: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the words up to WINDOW places away in the same text; part ascends."""
    if not len(words):
        return
    place = np.arange(len(words)) + WINDOW * part  # texts are that far apart, with zeros between
    own = np.zeros((place[-1] + 1 + WINDOW, WIDTH), np.int8)
    own[place] = index[words]
    near = np.zeros_like(own)
    for d in range(1, WINDOW + 1):
        near[d:] += own[:-d]
        near[:-d] += own[d:]
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums[ordered[first]] += np.add.reduceat(near[place[order]], first, axis=0, dtype=np.int32)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """docs (text), all rows and whole texts -> a row for each hash value: the normalised sum of its words' contexts, zero where none was met.

    Each task sums its own texts; parts of its table meet by number, so what is sent grows with the tasks and never with one word's frequency. A text beyond a million characters is taken in parts, at whose borders contexts end.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        index, sums = index_vectors(), np.zeros((BUCKETS, WIDTH), np.int64)
        for b in batches:
            for _, parts in groups(b.column(0).to_pylist()):
                t = Tokens(parts)
                add_contexts(sums, t.bucket, t.part, index)
        for k in range(0, BUCKETS, CHUNK):
            if sums[k : k + CHUNK].any():
                yield pa.record_batch([pa.array([k // CHUNK], pa.int32()), pa.array([sums[k : k + CHUNK].astype(_narrow(sums[k : k + CHUNK])).tobytes()])], names=["k", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, f"<i{len(data) // (CHUNK * WIDTH)}").astype(np.int64)
                total[k] = total[k] + own if k in total else own
        for k, own in total.items():
            rows = own.reshape(CHUNK, WIDTH).astype(np.float64)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([rows.astype(np.float32).tobytes()])], names=["k", "sums"])

    ready(docs.sparkSession)
    summed = docs.select("text").mapInArrow(gather, "k int, sums binary").repartition("k").mapInArrow(add, "k int, sums binary")
    out = np.zeros((BUCKETS // CHUNK, CHUNK, WIDTH), np.float32)
    for r in summed.collect():  # at most 8 MB, whatever the corpus
        out[r.k] = np.frombuffer(r.sums, np.float32).reshape(CHUNK, WIDTH)
    return out.reshape(BUCKETS, WIDTH)


def _narrow(a: np.ndarray) -> str:
    """The smallest type that holds these sums."""
    most = int(np.abs(a).max())
    return "<i1" if most < 128 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


class Pool:
    """Documents' rows: the mean of their words' vectors, then surface features: means over words, the log of their number, the shares of distinct words and of repeated lines, and whether there are none."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors

    def __call__(self, texts: list) -> np.ndarray:
        n = len(texts)
        total, count, kinds, lines, repeated = np.zeros((n, WIDTH + EXTRA)), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for owners, parts in groups(texts):
            t, of = Tokens(parts), np.array(owners)
            owner = of[t.part]
            total += sums_by(np.concatenate([self.vectors[t.bucket], t.surface()], axis=1), owner, n)
            count += np.bincount(owner, minlength=n)
            kinds += distinct(owner, t.hash, n)
            part, h = t.lines()
            lines += np.bincount(of[part], minlength=n)
            repeated += np.bincount(of[part], minlength=n) - distinct(of[part], h, n)
        c = np.maximum(count, 1)[:, None]
        return np.c_[total / c, np.log1p(count) / 8, kinds / c[:, 0], repeated / np.maximum(lines, 1), count == 0]


def loss_and_gradients(p: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted logistic loss of the two layers, with a small penalty on their weights, and its gradients."""
    h = np.maximum(0, x @ p[0] + p[1])
    z = np.clip(h @ p[2] + p[3], -30, 30)
    loss = float(np.mean(weight * np.logaddexp(0, np.where(y == 1, -z, z)))) + 5e-5 * float((p[0] ** 2).sum() + (p[2] ** 2).sum())
    g = weight * (1 / (1 + np.exp(-z)) - y) / len(x)
    back = np.outer(g, p[2]) * (h > 0)
    return loss, [x.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]


class Network:
    """Two layers in numpy, trained by Adam on logistic loss; the temperature is set on rows that training didn't see."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self._scale(x)
        held = rng.random(len(x)) < 0.2 if len(x) >= 50 else np.zeros(len(x), bool)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        self.p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        m, v, t = [0 * a for a in self.p], [0 * a for a in self.p], 0
        rows = np.flatnonzero(~held)
        for _ in range(epochs):
            rng.shuffle(rows)
            for at in range(0, len(rows), 128):
                r = rows[at : at + 128]
                _, grads = loss_and_gradients(self.p, x[r], y[r], weight[r])
                t += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.p[i] = self.p[i] - 0.004 * (m[i] / (1 - 0.9**t)) / ((v[i] / (1 - 0.999**t)) ** 0.5 + 1e-8)
        z, y, w = (a[held] if held.any() else a for a in (self._logit(x), y, weight))
        steps = np.geomspace(0.25, 8, 41)
        loss = [np.mean(w * np.logaddexp(0, np.where(y == 1, -1, 1) * z / t)) for t in steps]
        self.temperature = float(steps[int(np.argmin(loss))])

    def _scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(self._scale(x)) / self.temperature, -30, 30)))


class Model:
    def __init__(self, vectors: np.ndarray, network: Network | None):
        self.vectors, self.network = vectors, network

    def scorer(self):
        pool = Pool(self.vectors)
        return lambda texts: self.network.probability(pool(texts)) if self.network else np.full(len(texts), 0.5)


def pooled(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features and labels of about `most` labelled documents, whole texts; pooled where the texts are, so only features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        pool = Pool(vectors)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array(list(pool(b.column(1).to_pylist())), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = in_order(labelled(docs, labels, "quality", most).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>").collect())
    return np.array([r.x for r in rows], np.float64).reshape(len(rows), WIDTH + EXTRA + 4), np.array([r.y for r in rows], np.float64)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, corpus: DataFrame | None = None) -> Model:
    """docs (doc_id, text), labels (doc_id, quality) -> a model: word vectors from all texts of the corpus (docs, if none is given), the network from about `most` labelled rows of docs.

    Null texts are empty; rows whose label is null or neither 0 nor 1 don't count, and a document that is labelled twice is good if once it is; other columns aren't read. Without rows of both kinds, and so on an empty table, it scores 0.5 always.
    """
    vectors = word_vectors(docs if corpus is None else corpus)
    x, y = pooled(docs, labels, vectors, most)
    if not len(y) or y.min() == y.max():
        return Model(vectors, None)
    return Model(vectors, Network(x, y))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, with all their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array(np.asarray(score(b.column(place).to_pylist())) >= least))

    ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors come from all texts, labels from rows outside the held-out fold only."""
    docs, labels = spread(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "labels")
    held = fold(3) == 1
    model = fit(docs.where(~held), labels.where(~held), corpus=docs)
    return scored(docs, model.scorer, [F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")])
