"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. A line's unary score comes from character statistics of the line and
of its two neighbours; a transition matrix ties neighbouring labels. Only documents are labelled:
training starts with every line labelled as its document and then, in each further round,
relabels lines of bad documents that the field itself takes for good. The length-weighted mean
of the forward-backward marginals is the document's share of good text, which two logistic
coefficients turn into its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.session import python_path, read_table

#: at most so many labelled documents are used for training (the first by a hash of their ids)
SAMPLE_DOCS = 2500
#: of these only texts of at most so many characters each, and as many as have so many characters together
DOC_CHARS, SAMPLE_CHARS = 1_000_000, 32_000_000
_SYMBOLS = b"#$%&*|<>{}[]\\/=+_~^@`"
_CLASSES = 10


def _byte_class() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for lo, hi, k in ((0x61, 0x7B, 1), (0x41, 0x5B, 2), (0x30, 0x3A, 3), (0x80, 0x100, 5)):
        out[lo:hi] = k
    for chars, k in ((b" \t\r\x0b\x0c", 4), (_SYMBOLS, 6), (b".,;:?'\"()-", 7), (b"!", 8), (b"|", 9)):
        out[list(chars)] = k
    return out


_CLASS = _byte_class()
#: of a line: 9 shares of byte classes, doubled bytes, log length, log words, mean word length, ends as a sentence, repeated in its document, 4 indicators of these, share of words that repeat the one before, share of repeated words, 2 indicators of these
LINE_FEATURES = 23
FEATURES = 3 * LINE_FEATURES + 1


#: lines, and bytes unless one line has more, whose features are in memory at once
SLICE_LINES, SLICE_BYTES = 16_384, 4 << 20


class Lines:
    """A whole text's lines, their features a slice at a time; an empty or null text is one empty line."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass") + b"\n"
        stop = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10)
        self.start = np.concatenate(([0], stop[:-1] + 1))
        self.size = stop - self.start
        key = np.empty(len(stop), np.int64)
        for lo in range(0, len(stop), SLICE_LINES):
            ends = zip(self.start[lo : lo + SLICE_LINES].tolist(), stop[lo : lo + SLICE_LINES].tolist(), strict=True)
            key[lo : lo + SLICE_LINES] = [hash(self.raw[a:b]) for a, b in ends]
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        self.repeated = np.zeros(len(stop), bool)
        self.repeated[order[1:]] |= same
        self.repeated[order[:-1]] |= same
        self.repeated &= self.size > 0

    def __len__(self) -> int:
        return len(self.size)

    def slices(self) -> Iterator[tuple[int, int]]:
        lo, n = 0, len(self)
        while lo < n:
            hi = int(np.searchsorted(self.start, self.start[lo] + SLICE_BYTES))
            yield lo, (hi := min(max(hi, lo + 1), lo + SLICE_LINES, n))
            lo = hi

    def _own(self, lo: int, hi: int) -> np.ndarray:
        """The lines' own features."""
        n, size = hi - lo, self.size[lo:hi]
        first = int(self.start[lo])
        raw = self.raw[first : int(self.start[hi - 1] + size[-1]) + 1]
        data, start = np.frombuffer(raw, np.uint8), self.start[lo:hi] - first
        k = _CLASS[data]
        f = np.zeros((n, LINE_FEATURES))
        one = np.maximum(size, 1)
        for c in range(1, _CLASSES):
            f[:, c - 1] = np.add.reduceat(k == c, start, dtype=np.int64) / one
        doubled = np.zeros(len(data), bool)
        doubled[1:] = (data[1:] == data[:-1]) & (k[1:] >= 6)
        f[:, 9] = np.add.reduceat(doubled, start, dtype=np.int64) / one
        space = (k == 4) | (data == 10)
        heads = np.zeros(len(data), bool)
        heads[0] = not space[0]
        heads[1:] = ~space[1:] & space[:-1]
        words = np.add.reduceat(heads, start, dtype=np.int64)
        f[:, 10] = np.log1p(size) / 8
        f[:, 11] = np.log1p(words) / 6
        f[:, 12] = np.minimum(size / np.maximum(words, 1), 40) / 10
        last = data[start + np.maximum(size, 1) - 1]
        f[:, 13] = (size > 0) & ((last == 46) | (last == 63) | (last == 33))
        f[:, 14] = self.repeated[lo:hi]
        marks = f[:, 5] + f[:, 8] + f[:, 7]
        f[:, 15], f[:, 16], f[:, 17], f[:, 18] = marks > 0.04, marks > 0.12, f[:, 1] > 0.3, f[:, 1] > 0.6
        for i in np.flatnonzero(words > 3).tolist():
            w = raw[start[i] : start[i] + size[i]].split()
            if len(w) > 3:
                f[i, 19] = sum(map(eq, w, islice(w, 1, None))) / len(w)
                f[i, 20] = 1 - len(set(w)) / len(w)
        f[:, 21], f[:, 22] = f[:, 19] > 0.2, f[:, 20] > 0.7
        return f

    def features(self, lo: int, hi: int) -> np.ndarray:
        """(lines x FEATURES) of lines lo to hi: their own, and those of the line before and after each."""
        a, b = max(lo - 1, 0), min(hi + 1, len(self))
        f = self._own(a, b)
        out = np.zeros((hi - lo, FEATURES))
        out[:, :LINE_FEATURES] = f[lo - a : hi - a]
        before, after = f[: hi - 1 - a], f[lo + 1 - a :]
        out[len(out) - len(before) :, LINE_FEATURES : 2 * LINE_FEATURES] = before
        out[: len(after), 2 * LINE_FEATURES : 3 * LINE_FEATURES] = after
        out[:, -1] = 1
        return out


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, lengths in bytes) of a whole text, for training."""
    lines = Lines(text)
    return np.concatenate([lines.features(*s) for s in lines.slices()]), lines.size


@dataclass
class Model:
    unary: np.ndarray  #: weights of "good" against "bad"
    trans: np.ndarray  #: 2 x 2
    a: float = 1.0
    b: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of "good" for each line."""
        return self._smooth(x @ self.unary)

    def _smooth(self, unary: np.ndarray) -> np.ndarray:
        """Forward-backward in odds, r = message(good) / message(bad); ``unary`` becomes the marginals."""
        u = np.exp(np.clip(unary, -30, 30, out=unary), out=unary)
        (bb, bg), (gb, gg) = np.exp(self.trans).tolist()
        n = len(u)
        ahead, r = np.empty(n), None
        for lo in range(0, n, SLICE_LINES):
            part = []
            for x in u[lo : lo + SLICE_LINES].tolist():
                r = x if r is None else (bg + r * gg) / (bb + r * gb) * x
                part.append(r)
            ahead[lo : lo + SLICE_LINES] = part
        r = 1.0
        for lo in reversed(range(0, n, SLICE_LINES)):
            part = []
            for x, before in zip(u[lo : lo + SLICE_LINES].tolist()[::-1], ahead[lo : lo + SLICE_LINES].tolist()[::-1], strict=True):
                odds = before * r
                part.append(odds / (1 + odds))
                s = r * x
                r = (gb + s * gg) / (bb + s * bg)
            u[lo : lo + SLICE_LINES] = part[::-1]
        return u

    def good_share(self, text: str | None) -> float:
        """Mean of the lines' marginals, weighted by their lengths. Of a text with millions of lines only a few numbers each are held."""
        lines = Lines(text)
        unary = np.concatenate([lines.features(*s) @ self.unary for s in lines.slices()])
        return float(np.average(self._smooth(unary), weights=lines.size + 1.0))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * self.good_share(text) + self.b))))


def _gradient(model: Model, x: np.ndarray, y: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood over all sequences at once. steps[t]: the rows that are line t of those documents (longest first) that have one."""
    s = x @ model.unary
    psi = np.stack([np.zeros_like(s), s], 1)
    t = model.trans
    alpha, beta = np.zeros_like(psi), np.zeros_like(psi)
    for k, rows in enumerate(steps):
        alpha[rows] = psi[rows]
        if k:
            prev = alpha[steps[k - 1][: len(rows)]]
            alpha[rows] += np.logaddexp(prev[:, :1] + t[0], prev[:, 1:] + t[1])
    pair, g_trans = np.zeros((2, 2)), np.zeros((2, 2))
    for k in range(len(steps) - 1, 0, -1):
        rows = steps[k]
        prev = steps[k - 1][: len(rows)]
        nxt = psi[rows] + beta[rows]
        beta[prev] = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
        joint = alpha[prev][:, :, None] + t + nxt[:, None, :]
        joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(rows), 4), 1)[:, None, None])
        pair += joint.sum(0)
        np.add.at(g_trans, (y[prev], y[rows]), 1)
    z = alpha + beta
    p = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
    return x.T @ (y - p), g_trans - pair


def _fit_field(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int, l2: float = 1.0) -> Model:
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    sorted_lengths = lengths[order]
    steps = [first[: int((sorted_lengths > k).sum())] + k for k in range(int(lengths.max(initial=0)))]
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):  # Adam over whole batches: no order, no randomness
        gu, gt = _gradient(model, x, y, steps)
        g = np.concatenate((gu, gt.ravel())) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        model.unary, model.trans = theta[:-4], theta[-4:].reshape(2, 2)
    return model


def fit(sample: list[tuple[str | None, int]], rounds: int = 60, relabel: int = 2) -> Model:
    """From (text, quality) of labelled documents. Without both labels the score is the constant share of label 1 (0.5 if none)."""
    sample = sorted(((t or "", int(q)) for t, q in sample), key=lambda p: (p[0], p[1]))
    share = sum(q for _, q in sample) / len(sample) if sample else 0.5
    if share in (0, 1) or not sample:
        p = min(max(share, 0.01), 0.99)
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, math.log(p / (1 - p)))
    feats = [line_features(t) for t, _ in sample]
    x, size = np.concatenate([f for f, _ in feats]), [s for _, s in feats]
    lengths = np.array([len(s) for s in size])
    doc = np.repeat(np.arange(len(sample)), lengths)
    quality = np.array([q for _, q in sample])
    y = quality[doc]
    for turn in range(relabel + 1):
        model = _fit_field(x, y, lengths, rounds)
        p = np.concatenate([model.marginals(f) for f, _ in feats])
        if turn < relabel:
            worst = np.minimum.reduceat(p, np.concatenate(([0], np.cumsum(lengths)[:-1])))
            y = np.where((quality[doc] == 0) & (p > 0.7) & (p > worst[doc]), 1, quality[doc])
    w = np.concatenate(size) + 1.0
    good = np.bincount(doc, p * w) / np.bincount(doc, w)
    a, b = 0.0, 0.0
    weight = np.where(quality == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))  # both labels weigh alike
    for _ in range(50):  # Newton's method, lightly regularised
        q = 1 / (1 + np.exp(-(a * good + b)))
        r, h = weight * (quality - q), weight * q * (1 - q) + 1e-9
        g = np.array([(r * good).sum() - 0.01 * a, r.sum() - 0.01 * b])
        hess = np.array([[(h * good * good).sum() + 0.01, (h * good).sum()], [(h * good).sum(), h.sum() + 0.01]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(da, -5, 5)), b + float(np.clip(db, -5, 5))
    model.a, model.b = a, b
    return model


def held_out(id_col: str) -> F.Column:
    """Whether a document never takes part in training: crc32 of its id as text leaves 1 modulo 3. A null id isn't held out, and never used."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, doc_chars: int = DOC_CHARS) -> Model:
    """Fit on at most ``sample_docs`` labelled documents of ``sample_chars`` characters outside the held-out fold, chosen by a hash of their ids.

    Longer texts than ``doc_chars`` are passed over, not those after them. Rows that repeat an id
    are taken in the order of their texts' hashes, ``2 * sample_docs`` rows at most. Reruns agree.
    """
    picked = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample_docs)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    order = [F.xxhash64("id"), F.col("id"), F.col("label"), F.xxhash64("text"), F.col("text")]
    rows = texts.filter(F.col("size") <= doc_chars).join(F.broadcast(picked), "id").orderBy(*order).limit(2 * sample_docs)
    upto = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))  # over the bounded sample
    rows = rows.withColumn("upto", upto).filter(F.col("upto") <= sample_chars).select("text", "label").collect()
    return fit([(r.text, r.label) for r in rows])


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; only the text enters the score. Null and empty texts are scored as one empty line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    python_path(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, unchanged, whose score reaches ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    python_path(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores over ``documents``, learnt from ``labels``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    found = quality_scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
