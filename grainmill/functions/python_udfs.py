"""Text functions that no built-in expresses, as Arrow pandas UDFs over whole batches."""

from __future__ import annotations

import difflib
import textwrap
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair: one table for all pairs, a character of a at a time."""
    wide, high = max(map(len, b), default=0), max(map(len, a), default=0)
    codes = lambda texts, n, pad: np.array([[*map(ord, t), *[pad] * (n - len(t))] for t in texts], np.int32).reshape(len(texts), n)
    x, y = codes(a, high, -1), codes(b, wide, -2)
    row = np.zeros((len(a), wide + 1), np.int32)
    for p in range(high):  # the running maximum stands for the step to the right; a text that has ended matches nothing
        row[:, 1:] = np.maximum.accumulate(np.where(y == x[:, p, None], row[:, :-1] + 1, row[:, 1:]), axis=1)
    return row[:, -1]


def lcs_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """0 for an empty text, the ratio of lengths if one holds the other, else the longest common subsequence over the longer."""
    low, high = (np.array([f(len(x), len(y)) for x, y in zip(a, b, strict=True)], float) for f in (min, max))
    part = np.array([x in y or y in x for x, y in zip(a, b, strict=True)], bool)
    found, rest = low.copy(), np.flatnonzero(~part)
    rest = rest[np.argsort(high[rest], kind="stable")]
    for k in range(0, len(rest), 512):  # texts of a length together
        at = rest[k : k + 512]
        found[at] = common_lengths([a[i] for i in at], [b[i] for i in at])
    return np.where(low > 0, found / np.maximum(high, 1), 0.0)


def lcs_ratio(a: str, b: str) -> float:
    return float(lcs_ratios([a], [b])[0])


def partial_ratio(a: str, b: str) -> float:
    """The best match, 0 to 100, of the shorter text with a part of the longer."""
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return 0.0
    best = 0.0
    for i, j, _ in difflib.SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        start = max(0, j - i)
        best = max(best, difflib.SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
    return round(100 * best)


VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in VOWELS and not (w[i] == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    form = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return sum(1 for x, y in zip(form, form[1:], strict=False) if x == "v" and y == "c")


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _cons(w, n - 1) and not _cons(w, n - 2) and _cons(w, n - 3) and w[-1] not in "wxy"


#: Fixed values of the published algorithm: the suffixes of steps 2 to 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(word: str) -> str:
    """The stem by Porter's algorithm (1980)."""
    w = word.lower()
    if len(w) <= 2:
        return w
    vowel = lambda s: any(not _cons(s, i) for i in range(len(s)))
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _pairs(score):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)

    return run


def lcs_similarity(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(lcs_ratios(a.fillna("").tolist(), b.fillna("").tolist()), dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairs(partial_ratio), "double")(a, b)


def porter_stem(words: Column) -> Column:
    def run(words: pd.Series) -> pd.Series:
        return words.map({w: stem(w) for w in words.dropna().unique()})

    return F.pandas_udf(run, "string")(words)


def wrapped(s: Column, width: int = 60) -> Column:
    """Words wrapped at a width."""

    @F.pandas_udf("string")
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "\n".join(textwrap.wrap(t, width, break_long_words=False)))

    return wrap(s)


def entities(tokens: Column, mapping: Mapping[str, str]) -> Column:
    """Phrases of a token array replaced by their entity, the longest first, from left to right."""
    phrases = {tuple(k.split()): v for k, v in mapping.items()}
    longest = max(map(len, phrases), default=0)

    @F.pandas_udf("array<string>")
    def replace(arrays: pd.Series) -> pd.Series:
        def one(a) -> list[str]:
            out, i, a = [], 0, list(a)
            while i < len(a):
                n = next((n for n in range(min(longest, len(a) - i), 0, -1) if tuple(a[i : i + n]) in phrases), 0)
                out.append(phrases[tuple(a[i : i + n])] if n else a[i])
                i += n or 1
            return out

        return arrays.map(lambda a: None if a is None else one(a))

    return replace(tokens)
