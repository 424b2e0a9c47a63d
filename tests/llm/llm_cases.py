"""Small tables with every awkward case, and plain versions of the operators to hold results against."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, exact, near and partial copies, inner repeats, one long text, odd characters."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, long = say(60), say(9000)
    near = say(200).split()
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two Words"), (6, say(120)), (8, say(30) + "\n" + passage + "  " + say(20)),
        (9, passage), (10, "x " + passage.upper()), (11, say(40) + " " + passage), (12, "na " * 300), (13, long), (14, long[:4000]),
        (15, "😀▁ ﬁ\r\n" + say(50) + "\x00\x7f"), (16, "word" * 3000), (None, say(80)), (20, say(11)), (21, "\n".join([say(12)] * 6)),
    ]
    out.append((7, out[5][1]))  # an exact copy
    out.append((6, out[5][1]))  # the same row again
    for k in range(5):
        w = list(near)
        w[20 * k] = "changed"
        out.append((30 + k, " ".join(w)))
    return out


def frame(spark, rows=None):
    """The texts as documents, with columns whose names clash with inner ones."""
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", len(t or ""), 1.0, 5, "b", True) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, key int, fp string, kept boolean").repartition(3)


def empty(spark):
    return frame(spark, []).limit(0)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substrings(rows, size: int = 35):
    words = [SPACE.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if n[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode())))
    return out


def byte_strings(rows, size: int = 400):
    raw = [(t or "").encode() for _, t in rows]
    n = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if n[b[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def fingerprint(text: str | None) -> int:
    w = SPACE.findall((text or "").translate(ASCII_LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values: list[int], radius: int = 4) -> list[int]:
    """For each value the place of the first one that it reaches."""
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius:
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return [find(i) for i in range(len(values))]


def decontaminated(rows, items, size: int = 10):
    windows: dict[tuple, set] = {}
    for item, t in items:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        m = min(size, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall((t or "").translate(ASCII_LOWER)), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if got := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def quality(t: str | None):
    t = t or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep = {k + j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(5)}
    symbols, dup = sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    chars = sum(map(len, w))
    base = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    bad = base or 10 * symbols > len(w) or 10 * t.count("!") > len(w) or 10 * dup > 3 * len(lines) or not 2 * len(w) <= chars <= 20 * len(w) or 2 * up > up + low
    return len(w), chars, symbols, dup, len(rep), base, not bad
