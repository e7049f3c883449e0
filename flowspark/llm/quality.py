"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good (from labels: toxic 1; else quality 0 or 1). One weight vector over
hashed text features is shared by all grades, with ordered thresholds t: P(grade <= k) = logistic(t_k - score).
The expected grade is the sum of the tail probabilities P(grade > k); a document is kept where its tail
probability of the best grade reaches KEEP.

Features: presence of each lower-cased word and of its first bytes (hashed), and shares of the words' shapes (classes of the first and the
last three bytes), of words that repeat the one before, and of distinct words. All come from the whole text.

The model is fitted on the driver from at most SAMPLE labelled rows, chosen by a hash of doc_id; that bound is a
parameter. All documents are scored. Null labels are not used; of several rows with one doc_id fitting sees one, and
of several labels the worst. Without labelled rows of two grades the scores are those of the prior, and all documents
are kept. A null text counts as empty; an empty text is kept like any other by its score. Repeated rows score alike.
Other columns are kept, but for expected_grade, tail_probability and kept, whose place the operator's columns take. An
empty table gives an empty result. Texts are read whole, with some tens of bytes of memory for each of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, pieces_of, schema_with, table

WIDTH, SHAPES, EXTRA, HEADS = 1 << 20, 6**4, 4, (4, 5)
SAMPLE, KEEP, GRADES = 8000, 0.5, 3
_CLASS = np.full(256, 4, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: (row, hashed word) of its distinct words as two arrays, and its dense row of shares."""
    w = Words(texts, lower=True)
    n = len(texts)
    size = np.maximum(np.diff(w.first), 1)
    names = [w.h] + [w.head(k) ^ np.uint64(0x5851F42D4C957F2D * k % 2**64) for k in HEADS]
    pairs = np.unique(np.concatenate([w.doc * np.int64(WIDTH) + (h % np.uint64(WIDTH)).astype(np.int64) for h in names]))
    row, word = pairs // WIDTH, pairs % WIDTH
    shape, length = np.zeros(len(w.h), np.int64), w.end - w.start
    for k in (None, 1, 2, 3):
        at = w.start if k is None else np.maximum(w.end - k, 0)
        part = _CLASS[w.data[at]] if len(at) else at
        shape = shape * 6 + (part if k is None else np.where(length >= k, part, 5))
    dense = np.zeros((n, SHAPES + EXTRA), np.float32)
    dense[:, :SHAPES] = np.sqrt(np.bincount(w.doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / size[:, None])
    again = np.zeros(len(w.h))
    again[1:] = (w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1])
    dense[:, SHAPES] = np.sqrt(np.bincount(w.doc, again, n) / size)
    dense[:, SHAPES + 1] = np.bincount(row, minlength=n) / size / (1 + len(HEADS))
    dense[:, SHAPES + 2] = np.log1p(np.diff(w.first)) / 10
    dense[:, SHAPES + 3] = np.minimum(np.bincount(w.doc, length, n) / size / 20, 2)
    return row, word, dense


class Ordinal:
    """Weights of words and shares, thresholds."""

    def __init__(self, words: np.ndarray, shares: np.ndarray, thresholds: np.ndarray):
        self.words, self.shares, self.thresholds = words, shares, thresholds

    def score(self, texts: pa.Array) -> np.ndarray:
        row, word, dense = features(texts)
        return np.bincount(row, self.words[word], len(texts)) + dense @ self.shares

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each k below the best grade."""
        return _logistic(self.score(texts)[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, words: np.ndarray, dense: np.ndarray, grade: np.ndarray, steps: int = 200, least: int = 12, penalty: float = 3e-4) -> Ordinal:
    """Maximum likelihood with an L2 penalty by Adam. Words in fewer than least rows keep weight 0. Thresholds are
    a first one and positive gaps."""
    n, top = len(grade), GRADES - 1
    use = np.bincount(words, minlength=WIDTH) >= least
    held = use[words]
    rows, names = rows[held], np.flatnonzero(use)
    place = np.zeros(WIDTH, np.int64)
    place[names] = np.arange(len(names))
    cols = place[words[held]]
    live = np.flatnonzero(dense.any(axis=0))
    x = dense[:, live].astype(np.float64)
    share = np.bincount(grade, minlength=GRADES) + 1.0
    start = np.log(np.cumsum(share)[:-1] / (share.sum() - np.cumsum(share)[:-1]))
    p = np.concatenate([np.zeros(len(names) + len(live)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v, a, b = np.zeros_like(p), np.zeros_like(p), len(names), len(names) + len(live)
    if len(np.unique(grade)) > 1:
        for t in range(1, steps + 1):
            cuts = np.cumsum(np.concatenate([p[b : b + 1], np.exp(p[b + 1 :])]))
            s = np.bincount(rows, p[cols], n) + x @ p[a:b]
            low = np.where(grade > 0, _logistic(cuts[np.maximum(grade - 1, 0)] - s), 0.0)
            high = np.where(grade < top, _logistic(cuts[np.minimum(grade, top - 1)] - s), 1.0)
            mass = np.maximum(high - low, 1e-9)
            dlow, dhigh = low * (1 - low) * (grade > 0), high * (1 - high) * (grade < top)
            ds = (dhigh - dlow) / mass / n
            dcut = np.zeros(top)
            for k in range(top):
                dcut[k] = -(1 / mass / n * np.where(grade == k, dhigh, np.where(grade == k + 1, -dlow, 0))).sum()
            tail = np.cumsum(dcut[::-1])[::-1]
            g = np.concatenate([np.bincount(cols, ds[rows], len(names)) + penalty * p[:a], x.T @ ds + 1e-4 * p[a:b], tail[:1], tail[1:] * np.exp(p[b + 1 :])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights, shares = np.zeros(WIDTH, np.float32), np.zeros(SHAPES + EXTRA, np.float32)
    weights[names], shares[live] = p[:a], p[a:b]
    return Ordinal(weights, shares, np.cumsum(np.concatenate([p[b : b + 1], np.exp(p[b + 1 :])])))


def fit_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fitted on at most sample labelled documents; only their hashed features come to the driver."""
    graded = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("doc_id IS NOT NULL AND q IS NOT NULL AND t IS NOT NULL")
    graded = graded.select("doc_id", F.when(F.col("t") > 0, 0).otherwise(1 + (F.col("q") > 0).cast("int")).alias("grade"))
    chosen = graded.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    def hashed(batches):
        for batch in batches:
            for part in pieces_of(batch, 0):
                row, word, dense = features(part.column(0))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                where, what = np.nonzero(dense)
                at = np.searchsorted(where, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(ends, pa.array(word.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(what.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(dense[where, what]))], names=["grade", "words", "at", "share"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    found = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("grade").alias("grade")).select("text", "grade")
    got = found.mapInArrow(hashed, "grade int, words array<int>, at array<int>, share array<float>").toArrow()
    n = got.num_rows
    flat = lambda name: got.column(name).combine_chunks() if n else None
    if not n:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SHAPES + EXTRA)), np.zeros(0, np.int64))
    rows_of = lambda x: np.repeat(np.arange(n), np.diff(x.offsets.to_numpy()))
    words, at, share = flat("words"), flat("at"), flat("share")
    dense = np.zeros((n, SHAPES + EXTRA), np.float32)
    dense[rows_of(at), at.flatten().to_numpy()] = share.flatten().to_numpy()
    return fit(rows_of(words), words.flatten().to_numpy().astype(np.int64), dense, got.column("grade").to_numpy().astype(np.int64))


def grade(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """docs with expected_grade, tail_probability (of the best grade) and kept, which take the place of columns
    of these names."""
    names = ["expected_grade", "tail_probability", "kept"]
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def graded(batches):
        for batch in batches:
            for part in pieces_of(batch, at):
                tails = model.tails(part.column(at))
                best = tails[:, -1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(best), pa.array(best >= keep)], names=[*part.schema.names, *names])

    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(graded, schema_with(docs, *zip(names, kinds, strict=True)))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_labels(docs, table(spark, sf_dir, "labels"))
    return grade(docs.select("doc_id", "text"), model).drop("text")
