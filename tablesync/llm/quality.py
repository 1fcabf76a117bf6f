"""Quality classification with a linear-chain conditional random field over lines (operator 9).

Every line of a document is labelled good or bad. A line's features are counts of its own (letters,
capitals, digits, symbols, repeated words, ...) and some of the line before and after. A line's label
depends on its features and on its neighbours' labels. Forward and backward sums give each line's
probability of being good; their mean, weighted by line length, is the document's quality, which a
logistic curve turns into the probability of label 1.

Learning: the lines of a labelled document take its label. At most 4,000 labelled documents (the
first by a hash of the id) give chains of at most 32 lines, of which at most 8,000 (the first by a
hash) are learned from, on the driver, by gradient steps on the regularised log-likelihood: that is
under 40 MB whatever the corpus. Scoring is one pass over whole texts, without a shuffle.

Defined cases: null or empty text: one line of length 0, whose probability is the score; lines of
length 0 weigh nothing beside others; labels other than 0 and 1, and documents without label or id,
are not learned from; several labels of one document: the least counts; no label at all: every score
is 0.5; null id: not held out; repeated rows are all returned; empty table: no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import map_texts

#: Of five folds by ``crc32(id) mod 5``, this one is held out; from this score on, a document is predicted good.
FOLDS, HELD, GOOD_FROM = 5, 0, 0.3

#: Bounds of what is learned from.
SAMPLE_DOCS, SAMPLE_CHAINS, CHAIN = 4_000, 8_000, 32

#: Steps, step size and weight decay of learning.
STEPS, RATE, DECAY = 300, 0.1, 3e-3

_OF = {
    "letters": bytes(c for c in range(256) if c >= 128 or chr(c).isalpha()),
    "capitals": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "blanks": b" \t",
    "stops": b".,;:?'\"()-",
    "bars": b"|<>[]{}\\/=_+~^`",
    "bangs": b"!",
    "symbols": b"#$%&*@",
}
OWN = 2 + len(_OF) + 4
#: Of a neighbour: letters, capitals, bars, bangs, symbols, adjacent repeats.
SHARED = (2, 3, 7, 8, 9, 11)
LENGTH = 1  # the feature that holds the logarithm of a line's length
WIDTH = OWN + 2 * (len(SHARED) + 1)


def own_features(line: bytes) -> list[float]:
    n = len(line)
    per = 1.0 / n if n else 0.0
    shares = [(n - len(line.translate(None, kind))) * per for kind in _OF.values()]
    words = line.split()
    k = len(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (k - 1) if k > 1 else 0.0
    distinct = len(set(words)) / k if k else 0.0
    return [1.0, math.log1p(n) / 8, *shares, distinct, again, (n / k / 10 if k else 0.0), float(n == 0)]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every line, and the lines' lengths."""
    lines = text.split(b"\n")
    own = np.array([own_features(x) for x in lines], np.float32)
    shared = own[:, SHARED]
    out = np.zeros((len(lines), WIDTH), np.float32)
    out[:, :OWN] = own
    k = len(SHARED)
    out[1:, OWN : OWN + k] = shared[:-1]
    out[0, OWN + k] = 1
    out[:-1, OWN + k + 1 : OWN + 2 * k + 1] = shared[1:]
    out[-1, OWN + 2 * k + 1] = 1
    return out, np.fromiter(map(len, lines), np.int64, len(lines))


class Field:
    """Weights of line features (for good against bad) and of the four label pairs (from, to); ``curve``: slope, offset."""

    def __init__(self, weights: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.weights = np.zeros(WIDTH) if weights is None else weights
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs
        self.curve = (1.0, 0.0)

    def marginals(self, rows: np.ndarray) -> np.ndarray:
        """The probability of good, for every line of one document."""
        odds = np.exp(np.clip(rows @ self.weights, -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.pairs).tolist()
        ahead, good = [], 0.0
        for t, e in enumerate(odds):
            g, b = (e, 1.0) if t == 0 else ((good * gg + (1 - good) * bg) * e, good * gb + (1 - good) * bb)
            good = g / (g + b)
            ahead.append(good)
        out, g, b = [0.0] * len(odds), 1.0, 1.0
        for t in range(len(odds) - 1, -1, -1):
            a = ahead[t]
            out[t] = a * g / (a * g + (1 - a) * b)
            e = odds[t]
            g, b = gg * e * g + gb * b, bg * e * g + bb * b
            g, b = g / (g + b), b / (g + b)
        return np.array(out)

    def score(self, text: bytes | None) -> float:
        rows, lengths = features(text or b"")
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-(slope * _logit(self.quality(rows, lengths)) + offset))))

    def quality(self, rows: np.ndarray, lengths: np.ndarray) -> float:
        """The mean probability of good, weighted by line length."""
        good = self.marginals(rows)
        return float(good @ lengths / lengths.sum()) if lengths.sum() else float(good.mean())


def _logit(share: float) -> float:
    return math.log((share + 1e-6) / (1 - share + 1e-6))


def curve(shares: list[float], labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from mean probabilities to labels, by damped Newton steps."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x = np.stack([np.array([_logit(s) for s in shares]), np.ones(len(shares))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (labels - p) - 0.01 * (at - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        at = at + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return max(float(at[0]), 1e-3), float(at[1])


def fit(rows: np.ndarray, real: np.ndarray, labels: np.ndarray) -> Field:
    """Learn from chains: ``rows`` (chain, line, feature), ``real`` (which lines exist), ``labels`` (per chain)."""
    if not len(rows):
        return Field()
    chains, longest, _ = rows.shape
    flat = rows.reshape(-1, WIDTH)
    params, mean, square = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    lengths = real.sum(axis=1)
    total = real.sum()
    for step in range(1, STEPS + 1):
        gain = np.zeros((chains, longest, 2))
        gain[:, :, 1] = np.clip((flat @ params[:WIDTH].astype(np.float32)).reshape(chains, longest), -30, 30)
        emit, pair = np.exp(gain), np.exp(params[WIDTH:].reshape(2, 2))
        forward, backward = np.ones((chains, longest, 2)), np.ones((chains, longest, 2))
        forward[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            f = (forward[:, t - 1] @ pair) * emit[:, t]
            forward[:, t] = f / f.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            b = (emit[:, t + 1] * backward[:, t + 1]) @ pair.T
            backward[:, t] = np.where(real[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        both = forward * backward
        good = both[:, :, 1] / both.sum(axis=2)
        error = np.where(real, labels[:, None] - good, 0.0)
        slope = np.zeros(WIDTH + 4)
        slope[:WIDTH] = error.reshape(-1).astype(np.float32) @ flat
        for t in range(1, longest):
            joint = forward[:, t - 1, :, None] * pair * (emit[:, t] * backward[:, t])[:, None, :]
            joint = joint / joint.sum(axis=(1, 2), keepdims=True)
            slope[WIDTH:] -= joint[real[:, t]].sum(axis=0).reshape(4)
        steps = np.maximum(lengths - 1, 0)
        slope[WIDTH] += steps[labels == 0].sum()
        slope[WIDTH + 3] += steps[labels == 1].sum()
        slope = slope / total - DECAY * params
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        params = params + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(params[:WIDTH], params[WIDTH:].reshape(2, 2))


def held_out(name: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "at", "quality", "rows"]
    for batch in batches:
        for i, label, text in zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            rows, _ = features(text.as_py() or b"")
            cuts = [rows[x : x + CHAIN].tobytes() for x in range(0, len(rows), CHAIN)]
            n = len(cuts)
            columns = [pa.array([i] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([label] * n, pa.int32()), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)


def learned(docs: DataFrame, labels: DataFrame) -> Field:
    """The field, learned from a bounded sample of the labelled rows that are not held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("quality").isin(0, 1))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    chains = map_texts(texts.select("doc_id", "quality", "text"), _chains, "doc_id long, at int, quality int, rows binary")
    sample = chains.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "rows").limit(SAMPLE_CHAINS).select("doc_id", "quality", "rows")
    found = sample.toArrow()
    lists = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in found.column("rows").to_pylist()]
    rows, real = np.zeros((len(lists), CHAIN, WIDTH), np.float32), np.zeros((len(lists), CHAIN), bool)
    for i, x in enumerate(lists):
        rows[i, : len(x)], real[i, : len(x)] = x, True
    labels = np.array(found.column("quality").to_pylist(), np.int64)
    field = fit(rows, real, labels)
    by_doc: dict[int, list[int]] = {}
    for i, doc in enumerate(found.column("doc_id").to_pylist()):
        by_doc.setdefault(doc, []).append(i)
    shares = []
    for parts in by_doc.values():
        own = np.concatenate([lists[i] for i in parts])
        shares.append(field.quality(own, np.expm1(own[:, LENGTH] * 8)))
    field.curve = curve(shares, labels[[parts[0] for parts in by_doc.values()]])
    return field


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([field.score(t.as_py()) for t in batch.column("text").cast(pa.binary())], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    out = scored(docs, learned(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
