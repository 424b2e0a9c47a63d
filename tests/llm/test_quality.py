"""Quality trees against a plain trainer and plain statistics; awkward tables."""

from __future__ import annotations

import os
import re
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from grainmill.llm import quality, vec  # noqa: E402
from grainmill.llm.stats import Stats  # noqa: E402


def test_statistics_are_those_of_a_plain_count():
    rows = [t or "" for _, t in cases.texts()] + ["One Two!! 3\nOne Two!! 3\n\n#x", "ÀB cd."]
    x = quality.features(Stats(*vec.flat(pa.array(rows))))
    at = {name: k for k, name in enumerate(quality.FEATURES)}
    for t, got in zip(rows, x, strict=True):
        w = cases.SPACE.findall(t)
        n, lines = max(1, len(w)), [line for line in t.split("\n") if cases.SPACE.search(line)]
        up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
        want = {
            "log_words": np.log1p(len(w)), "word_length": sum(map(len, w)) / n, "symbols": sum(t.count(c) for c in "#*$%&|<>") / n, "bangs": t.count("!") / n,
            "upper": up / max(1, up + low), "digits": len(re.findall("[0-9]", t)) / n, "lines": len(lines) / n, "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
            "distinct_words": len(set(w)) / n, "repeat_words": cases.quality(t)[4] / n, "bytes_per_char": len(t.encode()) / max(1, sum(map(len, w))),
        }
        for name, value in want.items():
            assert np.isclose(got[at[name]], value, rtol=1e-5), (name, t[:40])


def plain_tree(x, y, depth, rate, least, l2):
    """One round of boosting from the prior, splits tried at every value between two rows."""
    prior = np.log(y.mean() / (1 - y.mean()))
    p = 1 / (1 + np.exp(-prior))
    g, h = p - y, np.full(len(y), p * (1 - p))
    out = np.full(len(y), prior)

    def grow(at, level):
        best = (1e-6, None)
        for j in range(x.shape[1]) if level < depth else ():
            for c in np.unique(x[at, j])[1:]:
                left = at[x[at, j] < c]
                right = at[x[at, j] >= c]
                if h[left].sum() >= least and h[right].sum() >= least:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None:
            out[at] -= rate * g[at].sum() / (h[at].sum() + l2)
        else:
            for s in best[1]:
                grow(s, level + 1)

    grow(np.arange(len(y)), 0)
    return out


def test_a_tree_against_a_plain_one():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (400, 3)).astype(np.float32)  # fewer values than bins: the histograms lose nothing
    y = ((x[:, 0] > 9) ^ (x[:, 1] > 14)).astype(float)
    y[rng.random(400) < 0.1] = 0
    model = quality.train(x, y, trees=1, depth=2, rate=0.3, bins=64, l2=1.0, least=5.0)
    assert np.allclose(model.margin(x), plain_tree(x, y, 2, 0.3, 5.0, 1.0))


def test_awkward_tables(spark):
    long = "good word. " * 4000
    rows = [(i, long if i == 1 else ("BAD!! " * 30 if i % 2 else "a fine day it was. " * 9) + str(i)) for i in range(80)] + [(None, "x"), (1, None), (2, "")]
    docs = cases.frame(spark, rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)] + [(4, 0), (4, 1)], "doc_id long, quality int")
    model = quality.train(*quality.sample(docs, labels, "quality", 4, 2, 1000), least=1.0)
    got = quality.score(docs.union(docs), model).collect()
    assert len(got) == 2 * len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id > 2]) > 0.9
    assert quality.score(cases.empty(spark), model).count() == 0
    none = quality.train(*quality.sample(cases.empty(spark), labels, "quality", 4, 2, 1000))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
