"""Statistics of whole documents, computed lazily for a chunk of texts at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from . import vec

SYMBOLS = b"#*$%&|<>"


def _in(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


UPPER, LOWER, DIGIT = (_in(bytes(range(ord(a), ord(b) + 1))) for a, b in ("AZ", "az", "09"))
HEAD = _in(bytes(x for x in range(256) if x & 0xC0 != 0x80))  # the first byte of a code point


class Stats:
    """Each property holds one value a text; only what is asked for is computed.

    Nulls count as empty texts; an empty text has zero of everything.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1

    def subset(self, keep: np.ndarray) -> Stats:
        """The same for some of the texts, in order; what is known already is not computed again."""
        at = np.flatnonzero(keep)
        lens = np.diff(self.offs)[at]
        offs = np.concatenate(([0], np.cumsum(lens)))
        buf = np.concatenate([self.buf[self.offs[i] : self.offs[i + 1]] for i in at]) if len(at) else self.buf[:0]
        out = Stats(buf, offs)
        for name in COUNTS:
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name][at]
        return out

    def _chars(self, table: np.ndarray) -> np.ndarray:
        return vec.per_text(table[self.buf], self.offs)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return vec.words(self.buf, self.offs)

    @cached_property
    def hashes(self) -> np.ndarray:
        return vec.span_hashes(self.buf, *self.spans[:2])

    def _salted(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return vec.mix(hashes + owner.astype(np.uint64) * vec.U64(0xD6E8FEB86659FD93))

    @cached_property
    def word_owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.spans[2]))

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.spans[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return vec.per_text(HEAD[self.buf] & ~vec.SPACE[self.buf], self.offs)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._chars(_in(SYMBOLS))

    @cached_property
    def n_bangs(self) -> np.ndarray:
        return self._chars(_in(b"!"))

    @cached_property
    def n_pipes(self) -> np.ndarray:
        return self._chars(_in(b"|"))

    @cached_property
    def n_stops(self) -> np.ndarray:
        return self._chars(_in(b".,;:?"))

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._chars(UPPER)

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self._chars(LOWER)

    @cached_property
    def n_digits(self) -> np.ndarray:
        return self._chars(DIGIT)

    @cached_property
    def n_capital_words(self) -> np.ndarray:
        starts, _, first = self.spans
        return vec.per_text(UPPER[self.buf[starts]], first)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line with a word its text's number, and a hash of its bytes and that number."""
        if not len(self.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        cut = np.zeros(len(self.buf) + 1, bool)
        cut[self.offs] = True
        newline = self.buf == 10
        edges = np.flatnonzero(cut[:-1] | np.concatenate(([False], newline[:-1])))
        starts = edges
        ends = np.concatenate((edges[1:], [len(self.buf)]))
        ends = ends - newline[ends - 1]
        has = np.searchsorted(self.spans[0], ends) > np.searchsorted(self.spans[0], starts)
        starts, ends = starts[has], ends[has]
        owner = np.searchsorted(self.offs, starts, side="right") - 1
        return owner, self._salted(vec.span_hashes(self.buf, starts, ends), owner)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=self.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        owner, keys = self._lines
        _, at = np.unique(keys, return_index=True)
        return self.n_lines - np.bincount(owner[at], minlength=self.n)

    @cached_property
    def n_distinct_words(self) -> np.ndarray:
        keys = self._salted(self.hashes, self.word_owner)
        _, at = np.unique(keys, return_index=True)
        return np.bincount(self.word_owner[at], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in 5-word windows found twice or more in the text, the first included."""
        first = self.spans[2]
        at = np.flatnonzero(vec.window_starts(first, 5))
        keys = self._salted(vec.window_hashes(self.hashes, 5)[at], self.word_owner[at])
        return vec.per_text(vec.cover(at[vec.repeated(keys)], 5, int(first[-1])), first)

    @cached_property
    def n_follow_words(self) -> np.ndarray:
        """Words equal to the word before them."""
        first = self.spans[2]
        same = np.zeros(int(first[-1]), bool)
        if len(same) > 1:
            same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.word_owner[1:] == self.word_owner[:-1])
        return vec.per_text(same, first)


COUNTS = [k for k in Stats.__dict__ if k.startswith("n_") or k == "word_chars"]
