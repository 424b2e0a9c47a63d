"""Substring dedup of word windows with a count-min prefilter.

A window is SIZE consecutive words of one document. First every task sketches its windows' hashes
and the sketches are merged; then only windows that the merged sketch counts twice or more, which
hold all that do repeat, are grouped exactly by 96-bit hashes; at last each word that a repeated
window covers is removed from its document. Windows are judged on the input, and a repeat inside
one document counts as any other.

Texts are read three times and shuffled once, at the end, to meet their places. Null and short texts
have no window; rows that are equal in every column are different documents, so their windows repeat.
Null ids are as any other. An empty table gives an empty result. Other columns pass through
clean() unchanged, but for n_chars, which follows the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats, vec

SIZE = 35
WORD_BYTES = 6.0  # an estimate, for the sketch's size


def windows(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, places of window starts among them, their hashes, and each text's first word."""
    starts, ends, first = vec.words(buf, offs)
    h = vec.span_hashes(buf, starts, ends)
    at = np.flatnonzero(vec.window_starts(first, size))
    return h, at, vec.window_hashes(h, size)[at], first


def places(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, int]:
    """Where repeated windows start, packed by document bucket, and the number of buckets."""
    rows = repeats.keyed(docs)
    n = repeats.buckets(docs)
    found = repeats.sketch(rows, lambda buf, offs: windows(buf, offs, size)[2], repeats.bits_for(rows, WORD_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def items(buf: np.ndarray, offs: np.ndarray) -> repeats.Items:
        h, at, h1, first = windows(buf, offs, size)
        some = shared.value.maybe(h1)
        h2 = vec.window_hashes(h, size, 1)[at[some]] if len(some) else np.zeros(0, np.uint64)
        text = np.searchsorted(first, at[some], side="right") - 1
        return repeats.Items(h1[some], h2 >> vec.U64(32), text, at[some] - first[text])

    return repeats.exact(rows, items, n), n


def _kept(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, by_key: dict[int, np.ndarray], size: int):
    """For each text its words, and which of them go."""
    raw, keys = buf.tobytes(), rows.column(1).to_pylist()
    for i, key in enumerate(keys):
        words = raw[offs[i] : offs[i + 1]].split()
        found = by_key.get(key)
        yield words, (None if found is None else repeats.covered(found, size, len(words)))


def report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by a space."""
    found, n = places(docs, size)

    def each(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, by_key: dict[int, np.ndarray]) -> pa.RecordBatch:
        words, gone, sha = [], [], []
        for ws, out in _kept(rows, buf, offs, by_key, size):
            words.append(len(ws))
            gone.append(0 if out is None else int(out.sum()))
            left = ws if out is None else [ws[k] for k in np.flatnonzero(~out).tolist()]
            sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
        return common.batch_of(doc_id=rows.column(0).field(0), n_words=pa.array(words, pa.int64()), n_removed=pa.array(gone, pa.int64()), kept_sha256=pa.array(sha, pa.string()))

    return repeats.applied(common.id_text(docs), found, n, each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with repeated words removed from the text; a text that loses none stays as it is."""
    found, n = places(docs, size)

    def each(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, by_key: dict[int, np.ndarray]) -> pa.RecordBatch:
        texts = rows.column(2).to_pylist()
        for i, (ws, out) in enumerate(_kept(rows, buf, offs, by_key, size)):
            if out is not None and out.any():
                texts[i] = b" ".join([ws[k] for k in np.flatnonzero(~out).tolist()]).decode("utf-8", "replace")
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["rest", "t"])

    rest = docs.select(F.struct(*(docs[c] for c in docs.columns if c != common.TEXT)).alias("rest")).schema["rest"].dataType.simpleString()
    out = repeats.applied(docs, found, n, each, f"rest {rest}, t string")
    cols = [F.col("t").alias(c) if c == common.TEXT else F.col("rest")[c].alias(c) for c in docs.columns]
    out = out.select(*cols)
    return out.withColumn("n_chars", F.length(common.TEXT).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS w FROM d, unnest(range(1, len(ws) - 33)) AS u(i)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY w) > 1),
p AS (SELECT doc_id, list(DISTINCT p) AS ps FROM r, unnest(range(i, i + 35)) AS u(p) GROUP BY doc_id),
k AS (
  SELECT doc_id, len(ws) AS n, coalesce(len(ps), 0) AS gone, ws, list_sort(coalesce(ps, [])) AS ps FROM d LEFT JOIN p USING (doc_id)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
j AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM x LEFT JOIN (SELECT doc_id, unnest(ps) AS i, true AS hit FROM p) AS g USING (doc_id, i) WHERE hit IS NULL GROUP BY x.doc_id)
SELECT doc_id, n::BIGINT AS n_words, gone::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN j USING (doc_id)
"""
