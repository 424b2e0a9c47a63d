"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's words are its runs of ASCII letters, digits and bytes above 0x7F, in lower case. Its
features are the distinct hashes, mod 2^bits, of its words, of pairs of neighbours and of pairs with
one word between. One task learns from a bounded sample of labelled documents, each coordinate at
its own rate; the L1 term leaves few weights, whose number 2^bits bounds, and only these and the
learner's state reach the driver and the executors. Every document is then scored in one pass without a shuffle.
Rate and L1 were chosen by cross-validation inside the rows that may teach.

Null and empty texts have no feature and get the score of the bias. Very long texts are read whole, and learned from
in rows of bounded size. Repeated rows are scored each; a null id has held_out null. An id labelled
twice counts once, by its largest label. Without labels the score is 0.5; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import common, vec

BITS = 20
#: Features of a text that go in one row.
LENGTH = 1024


def grams(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) arrays for words, pairs and skip-pairs; a feature may come again."""
    low = vec.LOWER[buf]
    starts, ends, first = vec.words(low, offs, vec.NONWORD)
    h = vec.span_hashes(low, starts, ends)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    shift = vec.U64(64 - bits)
    yield owner, (h >> shift).astype(np.int64)
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xA0761D6478BD642F)):
        if len(h) > gap:
            ok = owner[gap:] == owner[:-gap]
            pair = vec.mix(h[:-gap] * vec.U64(salt) + (h[gap:] ^ vec.U64(salt)))
            yield owner[:-gap][ok], (pair[ok] >> shift).astype(np.int64)


def distinct(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted."""
    keys = np.unique(np.concatenate([(t << bits) | f for t, f in grams(buf, offs, bits)]))
    return keys >> bits, keys & ((1 << bits) - 1)


@dataclass
class Learner:
    """FTRL-proximal state: z and n of each coordinate, the last being the bias, which has no L1."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, cost = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= cost, 0.0, -(z - np.sign(z) * cost) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, found: np.ndarray, label: int) -> None:
        """One step on a text with these distinct features."""
        at = np.append(found, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, bound: int = 4500, bits: int = BITS, epochs: int = 5, **rates: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The bias and the weights that aren't zero, as (features, weights).

    Learns from at most bound labelled documents of each class. Their features are written once, in rows of up to
    LENGTH; each epoch streams them by id hash through one task, which holds the state of 2^bits
    coordinates and one text's features. Rows equal in id and text count once.
    """
    chosen = common.labelled(labels, label, folds, held, bound).withColumnRenamed(common.ID, "_id")
    rows = common.hashed(docs).join(F.broadcast(chosen), F.col(common.ID) == F.col("_id")).select("_id", common.TEXT, "label", "th")

    def featurise(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in common.chunked(batch):
            text, feature = distinct(buf, offs, bits)
            ends = np.searchsorted(text, np.arange(len(offs)))
            pieces = np.maximum(1, -(-np.diff(ends) // LENGTH))
            row = np.repeat(np.arange(len(offs) - 1), pieces)
            first = ends[row] + LENGTH * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            x = pa.ListArray.from_arrays(pa.array(np.append(first, len(feature)), pa.int32()), pa.array(feature.astype(np.int32)))
            ids = np.asarray(part.column(0))[row]
            yield common.batch_of(turn=vec.mix(ids.astype(np.uint64)).view(np.int64), id=ids, th=part.column(3).take(pa.array(row)), label=part.column(2).take(pa.array(row)), x=x)

    sc, size = docs.sparkSession.sparkContext, (1 << bits) + 1
    state = Learner(np.zeros(size), np.zeros(size), **rates)
    with scratch.temporary(docs.sparkSession):
        sample = common.materialise(common.map_texts(rows, "turn long, id long, th long, label int, x array<int>", featurise), "features")
        for _ in range(epochs):
            known = np.flatnonzero(state.n)
            shared = sc.broadcast((known, state.z[known], state.n[known], rates))

            def epoch(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                at, z, n, rates = shared.value
                now = Learner(np.zeros(size), np.zeros(size), **rates)
                now.z[at], now.n[at] = z, n
                key, y, held_ = None, 0, []
                for b in batches:
                    ids, ths, ys = (b.column(k).to_pylist() for k in (1, 2, 3))
                    values, ends = np.asarray(b.column(4).flatten()), np.concatenate(([0], np.cumsum(b.column(4).value_lengths())))
                    for k in range(len(ids)):
                        if (ids[k], ths[k]) != key:
                            if held_:
                                now.learn(np.unique(np.concatenate(held_)), y)
                            key, y, held_ = (ids[k], ths[k]), ys[k], []
                        held_.append(values[ends[k] : ends[k + 1]])
                if held_:
                    now.learn(np.unique(np.concatenate(held_)), y)
                at = np.flatnonzero(now.n)
                yield common.batch_of(at=at, z=now.z[at], n=now.n[at])

            got = common.arrow(sample.repartition(1).sortWithinPartitions("turn", "id", "th"), epoch, "at long, z double, n double").toArrow()
            at = np.asarray(got["at"])
            state.z[at], state.n[at] = np.asarray(got["z"]), np.asarray(got["n"])
            shared.unpersist()
    w = state.weights(np.arange(size))
    used = np.flatnonzero(w[:-1])
    return float(w[-1]), used, w[used]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], folds: int = 3, held: int = 1, cut: float = 0.7, bits: int = BITS) -> DataFrame:
    bias, used, weight = model
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weight.astype(np.float32)))
    state: dict[str, np.ndarray] = {}

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not state:
            state["w"] = np.zeros(1 << bits, np.float32)
            state["w"][shared.value[0]] = shared.value[1]
        w = state["w"]
        for rows, buf, offs in common.chunked(batch):
            keys = []
            for text, feature in grams(buf, offs, bits):
                on = np.flatnonzero(w[feature])
                keys.append((text[on] << bits) | feature[on])
            key = np.unique(np.concatenate(keys))
            margin = bias + np.bincount(key >> bits, w[key & ((1 << bits) - 1)], len(offs) - 1)
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            yield common.batch_of(doc_id=rows.column(0), held_out=rows.column(2), score=p, predicted=(p >= cut).astype(np.int32))

    rows = common.id_text(docs).select("*", (common.crc_mod(F.col(common.ID), folds) == held).alias("held_out"))
    return common.map_texts(rows, "doc_id long, held_out boolean, score double, predicted int", each)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
