"""Merge-dropout: the same whatever else is in a chunk, and drawn for every occurrence."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa

from grainmill.llm import pieces, vec


def encoded(v, rows, **more):
    ids, ends = pieces.encode(v, *vec.flat(pa.array(rows)), np.arange(len(rows)), **more)
    return [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(rows))]


def test_a_long_unit_does_not_depend_on_its_chunk():
    v = pieces.load()
    word = "internationalisation"
    for seed in range(30):
        alone = encoded(v, [word], alpha=0.5, seed=seed)
        assert alone[0] == encoded(v, [word, word + "s"], alpha=0.5, seed=seed)[0] == encoded(v, [word, "a b", word + "xx"], alpha=0.5, seed=seed)[0]


def test_every_occurrence_is_drawn():
    v = pieces.load()
    ids = encoded(v, [" ".join(["internationalisation"] * 300)], alpha=0.3, seed=1)[0]
    edge = [k for k, i in enumerate(ids) if v.flat[v.offs[i]] == 0x20] + [len(ids)]
    assert len(edge) == 301 and len({tuple(ids[a:b]) for a, b in zip(edge, edge[1:], strict=False)}) > 4


def test_a_long_run_goes_through_its_own_agenda(monkeypatch):
    v = pieces.load()
    rows = ["x" * 300 + "internationalisation" * 9, "therefore" * 40 + "\U0001f600" + "abc" * 30]
    for alpha in (0.0, 0.2):
        with monkeypatch.context() as m:
            m.setattr(pieces, "LONG", 1 << 20)
            want = encoded(v, rows, alpha=alpha, seed=3)
        assert encoded(v, rows, alpha=alpha, seed=3) == want


def test_a_megabyte_without_a_space_takes_seconds():
    v = pieces.load()
    text = "".join(chr(97 + k * k % 26) for k in range(1 << 20))
    began = time.process_time()
    ids, ends = pieces.encode(v, *vec.flat(pa.array([text])), np.zeros(1, np.int64), 0.1)
    assert time.process_time() - began < 120
    assert pieces.decode(v, ids, ends)[0].tobytes().decode() == text
