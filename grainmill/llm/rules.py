"""Quality rules as a short-circuit cascade.

Each rule rejects documents by statistics of their whole text. On a small sample of whole documents the cascade
measures each rule's cost (seconds a document) and selectivity (share rejected) on what the rules before it leave, and orders the
rules by rejection per cost, so that cheap rules that reject much run first and costly ones see only
the survivors. A document is kept if no rule rejects it, so the order never changes a verdict.

Null and empty texts have no words and are rejected. Repeated rows get a verdict each. Null ids pass
through. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vec
from .stats import Stats


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], np.ndarray]


RULES = (
    Rule("few_words", lambda s: s.n_words < 10),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 20 * s.n_words),
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("exclamations", lambda s: 10 * s.n_bangs > s.n_words),
    Rule("duplicate_lines", lambda s: 10 * s.n_dup_lines > 3 * s.n_lines),
    Rule("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 20 * s.n_words)),
    Rule("capitals", lambda s: 2 * s.n_upper > s.n_upper + s.n_lower),
)


def measure(rule: Rule, stats: Stats) -> tuple[float, float]:
    """(seconds a document, share rejected) of a rule on a sample; what stats has worked out already costs nothing."""
    began = time.perf_counter()
    share = float(rule.rejects(stats).mean()) if stats.n else 0.0
    return (time.perf_counter() - began) / max(1, stats.n), share


def order(rules: tuple[Rule, ...], buf: np.ndarray, offs: np.ndarray, look: Callable[[Rule, Stats], tuple[float, float]] = measure) -> list[int]:
    """The rules by rejection per cost, the best first, each measured on what those before it leave; ties stay as given.

    Work that rules share is so charged to the first of them only.
    """
    out: list[int] = []
    while len(out) < len(rules):
        best = None
        for i in range(len(rules)):
            if i in out:
                continue
            s = Stats(buf, offs)
            for k in out:  # as it will be when this rule's turn comes
                s = s.subset(~rules[k].rejects(s))
            cost, share = look(rules[i], s)
            if best is None or share / max(cost, 1e-12) > best[0]:
                best = (share / max(cost, 1e-12), i)
        out.append(best[1])
    return out


def cascade(rules: tuple[Rule, ...], stats: Stats) -> np.ndarray:
    """True for the texts that no rule rejects; each rule sees only what those before it left."""
    kept = np.ones(stats.n, bool)
    alive, now = np.arange(stats.n), stats
    for rule in rules:
        if not len(alive):
            break
        bad = rule.rejects(now)
        if bad.any():
            kept[alive[bad]] = False
            alive, now = alive[~bad], now.subset(~bad)
    return kept


def fit(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = 256) -> tuple[Rule, ...]:
    """The rules in the order that a seeded sample of about sample_docs whole documents suggests; it only affects speed.

    One task measures the sample, so that only an order reaches the driver.
    """
    share = 1.2 * sample_docs / max(1, docs.count())
    rows = common.id_text(docs if share >= 1 else docs.sample(share, 7)).limit(sample_docs).repartition(1)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(1) for b in batches if b.num_rows]
        if held:
            yield common.batch_of(rule=np.array(order(rules, *vec.flat(pa.chunked_array(held))), np.int32))

    found = [r.rule for r in common.arrow(rows, ranked, "rule int").collect()]
    return tuple(rules[i] for i in found) or rules


def apply(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows of docs, all their columns, that the cascade keeps."""
    names = docs.columns
    spot = names.index(common.TEXT)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, offs = vec.flat(batch.column(spot))
        for a, b, part, own in vec.chunks(buf, offs):
            kept = cascade(rules, Stats(part, own))
            if kept.any():
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return common.map_texts(docs, docs.schema, each)


def report(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, the base statistics and the cascade's verdict for every document."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in common.chunked(batch):
            s = Stats(buf, offs)
            base = (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)
            kept = np.zeros(s.n, bool)
            kept[~base] = cascade(rules, s.subset(~base))
            yield common.batch_of(
                doc_id=rows.column(0), n_words=s.n_words, word_chars=s.word_chars, n_symbols=s.n_symbols,
                n_dup_lines=s.n_dup_lines, n_repeat_words=s.n_repeat_words, base_failed=base, kept=kept,
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return common.map_texts(common.id_text(docs), schema, each)


def op8_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return report(docs, fit(docs))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM r, unnest(range(i, i + 5)) AS u(p) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g')) AS bangs,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * bangs > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * upper > upper + lower) AS kept
FROM b
"""
