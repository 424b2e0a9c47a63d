"""Toxicity against a plain learner and plain features; awkward tables."""

from __future__ import annotations

import math
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from grainmill.llm import toxicity, vec  # noqa: E402


def test_features_are_words_pairs_and_skip_pairs():
    texts = ["", "One two,three one two", "é É 1", "a a a a"]
    text, feature = toxicity.distinct(*vec.flat(pa.array(texts)))
    got = [len(feature[text == k]) for k in range(len(texts))]
    plain = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(cases.ASCII_LOWER))
        plain.append(len({(x,) for x in w} | {("p", *x) for x in zip(w, w[1:], strict=False)} | {("s", *x) for x in zip(w, w[2:], strict=False)}))
    assert got == plain
    same = toxicity.distinct(*vec.flat(pa.array(["one TWO", "x one two"])))
    assert set(same[1][same[0] == 0]) <= set(same[1][same[0] == 1])


def test_learner_against_a_plain_one():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 40, 9)), int(rng.integers(2))) for _ in range(200)]
    fast = toxicity.Learner(np.zeros(41), np.zeros(41), alpha=0.5, l1=0.3, l2=0.1)
    z, n = [0.0] * 41, [0.0] * 41

    def weight(i):
        l1 = 0.0 if i == 40 else 0.3
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.1)

    for found, y in rows:
        fast.learn(found, y)
        at = [*found.tolist(), 40]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
            z[i], n[i] = z[i] + g - s * w[i], n[i] + g * g
    assert np.allclose(fast.weights(np.arange(41)), [weight(i) for i in range(41)])


def test_awkward_tables(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(6000))
    rows = [(i, ("scum " if i % 2 else "fine ") * 3 + (long if i < 8 else f"x{i}")) for i in range(60)] + [(7, None), (None, "scum"), (3, ""), (2, "")]
    docs = cases.frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(8, 1), (8, 0)], "doc_id long, toxic int")
    once, twice = toxicity.fit(docs, labels), toxicity.fit(docs.union(docs), labels)
    assert once[0] == twice[0] and (once[2] == twice[2]).all()  # repeated rows teach once
    assert toxicity.score(docs, once).count() == len(rows)
    none = toxicity.fit(cases.empty(spark), labels)
    assert none[0] == 0 and not len(none[1]) and toxicity.score(cases.empty(spark), once).count() == 0
    assert {r.score for r in toxicity.score(docs, none).select(F.col("score")).collect()} == {0.5}
