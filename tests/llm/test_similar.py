"""Near copies of the pipeline: Jaccard 0.8 of 5-word shingles, against brute force."""

from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from grainmill.llm import simhash, similar  # noqa: E402


def shingles(t):
    w = cases.SPACE.findall((t or "").translate(cases.ASCII_LOWER))
    m = min(5, len(w))
    return {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()


def least_ids(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min([x for x in (least.get(find(a)), i) if x is not None], default=None)
    return [(i, least[find(a)]) for a, (i, _) in enumerate(rows)]


def near(seed=3):
    """Texts at all distances from each other, with a line that all of them hold, and short ones."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 5000)}"
    line, rows = " ".join(word() for _ in range(12)), cases.texts()
    for base in range(14):
        w = [word() for _ in range(r.choice([6, 30, 90, 200]))]
        for k in range(12):
            x = list(w)
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                x[r.randrange(len(x))] = word()
            rows.append((1000 + 20 * base + k, " ".join(x) + (" " + line if base % 2 else "")))
    return rows


KEY = lambda r: tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("group", [similar.GROUP, 2])
def test_components_are_those_of_all_pairs(spark, group, monkeypatch):
    monkeypatch.setattr(similar, "GROUP", group)
    rows = near()
    got = [(r.doc_id, r.component_id) for r in similar.cluster(cases.frame(spark, rows)).collect()]
    assert sorted(got, key=KEY) == sorted(least_ids(rows), key=KEY)
    assert similar.cluster(cases.empty(spark)).count() == 0


def test_stage_joins_pairs_far_apart_in_bits(spark):
    rows = [(i, t) for i, t in near() if i is not None and i >= 1000]
    least = dict(least_ids(rows))
    assert any(bin(cases.fingerprint(t) ^ cases.fingerprint(dict(rows)[least[i]])).count("1") > 4 for i, t in rows)
    got = corpus_pipeline.near_duplicates(spark, cases.frame(spark, rows), "")
    assert {r.doc_id for r in got.collect()} == set(least.values())


@pytest.mark.parametrize("way", ["stage", "simhash"])
def test_one_row_of_a_component_stays(spark, way):
    r = random.Random(5)
    a, b, c, d, e = (" ".join(f"{x}{r.randint(0, 900)}" for _ in range(50)) for x in "abcde")
    rows = [(1, a), (2, b), (2, b), (2, b), (3, b), (None, c), (None, c), (None, d), (9, d), (1, e), (None, None), (None, None)]
    docs = cases.frame(spark, rows)
    docs = docs.withColumn("n_chars", docs.n_chars + 1).unionByName(cases.frame(spark, [(2, b)]))  # equal but for a column
    got = corpus_pipeline.near_duplicates(spark, docs, "") if way == "stage" else simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (9, d), (1, e), (None, None)], key=str)
