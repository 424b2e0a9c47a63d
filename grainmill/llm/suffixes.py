"""Substring dedup of byte strings by a difference cover and blockwise grouping.

A string is SIZE consecutive bytes of one document. For a difference cover D of period V, any two
places i and j have a step d < V with i + d and j + d both in D (mod V). So two equal strings hold,
at the same step, cover samples that agree in their first SIZE - V + 1 bytes. First the cover
samples (16 places in 181) are counted, and a bitmap of those that repeat is broadcast: a sample that occurs once rules out
every string that would have to agree there. Only strings in reach of a sample counted twice go on;
they are dealt into buckets by an 88-bit fingerprint of their SIZE bytes, and one bucket at a time is
sorted and its equal neighbours are repeated strings. Nothing is put in the alphabet's order: equal strings are all that dedup
asks for, and fingerprints deal evenly and have a fixed size however long a repeat is.

Before that, texts that are equal as wholes are settled by their hashes and one of each group stands
for it; a second bitmap, of the candidates' own strings, drops most that agree for less than SIZE.

Matches never cross documents; a repeat inside one document counts, overlapping or not. Strings are
judged on the input. Null and short texts hold no string; rows that are equal in every column are
different documents. Null ids are as any other. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats, vec

SIZE = 400
BITS = 29  # of a bitmap; two are held at a time


def difference_cover(r: int) -> tuple[int, list[int]]:
    """(period, members): every difference mod the period is one of two members (Colbourn and Ling, 2000)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, [0, *np.cumsum(steps).tolist()]


PERIOD, COVER = difference_cover(2)
DEPTH = SIZE - PERIOD + 1  # what two samples of equal strings have in common at least


def samples(offs: np.ndarray) -> np.ndarray:
    """Cover places with DEPTH bytes before their text's end, in order."""
    last = offs[1:] - DEPTH
    n = np.maximum(0, (last - offs[:-1]) // PERIOD + 1)  # periods in which a sample can start
    first = np.repeat(offs[:-1] - PERIOD * (np.cumsum(n) - n), n) + PERIOD * np.arange(n.sum())
    at = first[:, None] + np.array(COVER)
    return at[at <= np.repeat(last, n)[:, None]]


def sample_hashes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return _hashes(vec.sums(buf), samples(offs), DEPTH)


def _hashes(total: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of size bytes from each place on, by the bytes' sums; a part at a time, which stays in the cache."""
    out, back = np.empty(len(at), np.uint64), vec.inverses(len(total), which)
    for k in range(0, len(at), vec.BLOCK):
        x = at[k : k + vec.BLOCK]
        h = total[x + size]
        h -= total[x]
        h *= back[x]
        out[k : k + vec.BLOCK] = vec.mix(h)
    return out


def _owners(at: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The texts of places in order."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(at, offs)))


def _second(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The strings' other hashes, from the bytes that they cover alone."""
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + SIZE)))
    start, end = at[first], at[np.append(first[1:], len(at)) - 1] + SIZE
    part = np.concatenate([buf[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    gap = start - (np.cumsum(end - start) - (end - start))  # bytes left out before
    return _hashes(vec.sums(part, 1), at - np.repeat(gap, np.diff(np.append(first, len(at)))), SIZE, 1)


class Finder:
    """Candidate suffixes of a chunk of texts, by bitmaps that were broadcast."""

    def __init__(self, cover, strings=None):
        self.cover, self.strings = cover, strings

    def candidates(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that a sample counted twice or more has in reach, in order, and the hashes of their strings."""
        total, at = vec.sums(buf), samples(offs)
        at = at[self.cover.value.maybe(_hashes(total, at, DEPTH))]
        text = _owners(at, offs)
        low = np.maximum(at - (PERIOD - 1), offs[text])  # a string in reach of a sample starts at most PERIOD - 1 bytes before it
        low[1:] = np.maximum(low[1:], at[:-1] + 1)  # and is not in reach of the sample before
        n = np.maximum(0, np.minimum(at, offs[text + 1] - SIZE) - low + 1)
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, _hashes(total, at, SIZE)

    def items(self, buf: np.ndarray, offs: np.ndarray) -> repeats.Items:
        """Candidates that the second bitmap lets through.

        All of them answer. In a row of neighbours that are let through only the ends can be wrong
        (more than doubt() mistakes in a row do not happen), and a mistake between two right ones
        changes no byte, as strings are longer than the row of mistakes: so only the ends ask.
        """
        at, h = self.candidates(buf, offs)
        some = self.strings.value.maybe(h)
        at, h = at[some], h[some]
        text = _owners(at, offs)
        more = _second(buf, at) >> vec.U64(40)
        margin = self.strings.value.doubt()
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])))) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, size)
        ask = (place < margin) | (place >= np.repeat(size, size) - margin) | (margin >= SIZE)
        long = np.flatnonzero((size > 2 * margin) & (margin < SIZE))
        start = first[long] + margin
        runs = (text[start], at[start] - offs[text[start]], size[long] - 2 * margin)
        return repeats.Items(h, more, text, at - offs[text], ask, runs)

    def clean(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts have no candidate."""
        at, h = self.candidates(buf, offs)
        return np.diff(np.searchsorted(at[self.strings.value.maybe(h)], offs)) == 0


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    docs = common.id_text(docs)
    n = repeats.buckets(docs)
    share = docs.sparkSession.sparkContext.broadcast
    copies, whole = repeats.equal_texts(repeats.keyed(docs), SIZE, n)
    rows = repeats.beside(repeats.keyed(docs), copies).where("spare IS NULL OR NOT spare").select(common.ID, "key", common.TEXT)
    size = docs.agg(F.sum(F.octet_length(common.TEXT))).first()[0] or 0
    cover = share(repeats.counted(rows, sample_hashes, size * len(COVER) / PERIOD, BITS))
    near = Finder(cover)
    finder = Finder(cover, share(repeats.counted(rows, lambda buf, offs: near.candidates(buf, offs)[1], size / 8, BITS)))
    found = repeats.exact(rows, finder.items, n).union(whole)

    def each(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, by_key: dict[int, np.ndarray]) -> pa.RecordBatch:
        gone, spans, sha = [], [], []
        for i, key in enumerate(rows.column(1).to_pylist()):
            text, hit = buf[offs[i] : offs[i + 1]], by_key.get(key)
            out = repeats.covered(hit, SIZE, len(text)) if hit is not None else np.zeros(len(text), bool)
            gone.append(int(out.sum()))
            spans.append(len(vec.runs(out)[0]) if gone[-1] else 0)
            sha.append(hashlib.sha256((text[~out] if gone[-1] else text).tobytes()).hexdigest())
        return common.batch_of(
            doc_id=rows.column(0).field(0), n_bytes=np.diff(offs), n_removed=pa.array(gone, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept_sha256=pa.array(sha, pa.string()),
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.applied(docs, found, n, each, schema, finder.clean, copies)


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT k, n, a, substr(h, 2 * a + 1, 1600) AS s FROM d, unnest(range(0, greatest(n - 399, 0), 400)) AS u(a)),
w AS (SELECT k, a + i AS i, md5(substr(s, 2 * i + 1, 800)) AS m FROM b, range(0, 400) AS r(i) WHERE a + i <= n - 400),
r AS (SELECT k, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
p AS (SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + 400, true) AS new FROM r),
q AS (SELECT k, i, sum(new::INT) OVER (PARTITION BY k ORDER BY i) AS g FROM p),
x AS (SELECT k, g, min(i) AS s, max(i) + 400 AS e FROM q GROUP BY k, g),
t AS (SELECT k, sum(e - s) AS gone, count(*) AS spans FROM x GROUP BY k),
z AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS s, s AS e FROM x UNION ALL SELECT k, max(e), NULL FROM x GROUP BY k),
y AS (SELECT k, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, n) - s)), '' ORDER BY s) AS kept FROM z JOIN d USING (k) GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (k) LEFT JOIN y USING (k)
"""
