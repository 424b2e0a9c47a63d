"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown depth by depth on binned statistics of a bounded sample of labelled documents, on
gradient histograms, and flattened into arrays (feature, threshold, value by heap position) that
numpy walks for a whole batch at once. The statistics come from the text alone.

Null and empty texts are scored as texts of no words. Repeated rows are scored each; a null id is
held out by nothing (held_out null) and scored. Without labels of both classes the score is the
share of label 1, or 0.5 without any. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .stats import Stats

FEATURES = (
    "log_words", "word_length", "symbols", "bangs", "pipes", "stops", "upper", "digits", "capital_words", "lines",
    "dup_lines", "distinct_words", "repeat_words", "follow_words", "bytes_per_char",
)


def features(s: Stats) -> np.ndarray:
    """One row a text."""
    n, lines = np.maximum(s.n_words, 1), np.maximum(s.n_lines, 1)
    letters = np.maximum(s.n_upper + s.n_lower, 1)
    size = np.diff(s.offs)
    cols = (
        np.log1p(s.n_words), s.word_chars / n, s.n_symbols / n, s.n_bangs / n, s.n_pipes / n, s.n_stops / n, s.n_upper / letters,
        s.n_digits / n, s.n_capital_words / n, s.n_lines / n, s.n_dup_lines / lines, s.n_distinct_words / n, s.n_repeat_words / n,
        s.n_follow_words / n, size / np.maximum(s.word_chars, 1),
    )
    return np.stack(cols, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Flattened: node i of a tree has children 2i + 1 and 2i + 2; x < threshold goes left."""

    start: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves, the learning rate included

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Trees(float(np.log(p / (1 - p))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), prior)
    feature, threshold, value = (np.zeros((trees, n), t) for n, t in ((inner, np.int64), (inner, np.float32), (leaves, np.float64)))
    threshold[:] = np.inf  # a node that isn't split sends all to the left
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * bins) + flat).ravel()
            g, h = (np.bincount(place, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2) for v in (grad, hess))
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < least) | (ht - h < least)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k, at in enumerate(best):
                if gain[k].flat[at] > 1e-6:
                    feature[t, first + k], threshold[t, first + k] = at // bins, cuts[at // bins][at % bins]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] >= threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value[t] = -rate * g / (h + l2)
        margin += value[t, leaf]
    return Trees(prior, depth, feature, threshold, value)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and labels of at most bound documents of each class; only these numbers reach the driver."""
    chosen = common.labelled(labels, label, folds, held, bound).withColumnRenamed(common.ID, "_id")
    rows = common.id_text(docs).join(F.broadcast(chosen), F.col(common.ID) == F.col("_id")).select("_id", common.TEXT, "label")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in common.chunked(batch):
            x = features(Stats(buf, offs))
            yield common.batch_of(id=part.column(0), label=part.column(2), x=pa.array(list(x), pa.list_(pa.float32())))

    got = common.map_texts(rows, "id long, label int, x array<float>", each).toArrow().sort_by("id")
    x = np.asarray(got["x"].combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES))
    return x, np.asarray(got["label"], np.float64)


def score(docs: DataFrame, model: Trees, folds: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in common.chunked(batch):
            p = model.score(features(Stats(buf, offs)))
            yield common.batch_of(doc_id=rows.column(0), held_out=rows.column(2), score=p, predicted=(p >= cut).astype(np.int32))

    rows = common.id_text(docs).select("*", (common.crc_mod(F.col(common.ID), folds) == held).alias("held_out"))
    return common.map_texts(rows, "doc_id long, held_out boolean, score double, predicted int", each)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    x, y = sample(docs, labels, "quality", 4, 2, 6000)
    return score(docs, train(x, y))
