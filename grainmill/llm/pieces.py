"""SentencePiece (BPE) encoding with seeded merge-dropout, and decoding.

Encoding starts from characters and merges neighbours whose join is a piece, the best score first
and then the leftmost, as an agenda would. With dropout a keyed hash of (seed, text's key, place, unit,
start, split, end) skips each candidate merge with probability alpha: every occurrence of a word is
drawn by itself, always by merges, and decodes to the same text. Alpha 0 gives the model's own
segmentation.

No piece holds a space after another character, so texts are cut into units (a run of spaces and
what follows, cut again at characters that no merge uses); without dropout each distinct unit of a
chunk is encoded once, with it each occurrence, all units of a length together in numpy. Unknown characters become byte pieces. A literal
U+2581, which the model would read as a space, becomes bytes too, so decoding gives the text back.

Null and empty texts have no pieces and decode to an empty text. Repeated rows with one id get the
same pieces; null ids count as id 0. Very long texts are encoded whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vec
from .stats import HEAD

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 20
NONE = np.int32(2**31 - 1)
#: Symbols from which a unit has an agenda of its own, and cells that are merged at a time.
LONG, CELLS = 64, 1 << 19
#: Weights of a candidate's start, split and end in its hash.
PLACE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
M64 = (1 << 64) - 1
SPACE_MARK = "▁"


@dataclass
class Vocabulary:
    """What encoding needs of a model: sized by its vocabulary."""

    char: np.ndarray  # symbol of each code point, -1 if no merge or piece has it
    joins: np.ndarray  # does any merge use the symbol of this number
    keys: np.ndarray  # hash table of pairs of symbols ...
    rank: np.ndarray  # ... the rank of their merge, the best is 0 ...
    into: np.ndarray  # ... and the symbol it gives
    by_rank: np.ndarray  # the same by rank
    probes: int
    size: int  # pieces; symbols from here on are characters that are no piece
    byte: np.ndarray  # the piece of each byte
    flat: np.ndarray  # the bytes of all pieces, joined
    offs: np.ndarray

    def pairs(self) -> dict[int, int]:
        """The rank of each pair's merge."""
        if not hasattr(self, "_pairs"):
            used = self.keys >= 0
            self._pairs = dict(zip(self.keys[used].tolist(), self.rank[used].tolist(), strict=True))
        return self._pairs


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.vocab_size()
    text = [sp.id_to_piece(i) for i in range(size)]
    normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    assert not any(SPACE_MARK in text[i].lstrip(SPACE_MARK) for i in normal), "pieces must hold spaces only in front"
    symbol = {text[i]: i for i in normal}
    for c in sorted({c for i in normal for c in text[i]} - symbol.keys()):
        symbol[c] = size + len(symbol) - len(normal)
    char = np.full(0x110000, -1, np.int32)
    for s, i in symbol.items():
        if len(s) == 1:
            char[ord(s)] = i
    char[ord(" ")], char[ord(SPACE_MARK)] = char[ord(SPACE_MARK)], -1
    order = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-sp.get_score(i), i)))}
    pairs = [(symbol[text[i][:k]], symbol[text[i][k:]], order[i], i) for i in normal for k in range(1, len(text[i])) if text[i][:k] in symbol and text[i][k:] in symbol]
    left, right, rank, into = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    joins = np.zeros(max(symbol.values()) + 1, bool)
    joins[left], joins[right] = True, True
    key = (left << 32) | right
    bits = int(len(key)).bit_length() + 3
    keys, ranks, gives = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
    todo, probes = np.arange(len(key)), 0
    while len(todo):
        slot = _slot(key[todo], probes, bits)
        free = keys[slot] < 0
        _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
        one = one[free[one]]
        at = slot[one]
        keys[at], ranks[at], gives[at] = key[todo[one]], rank[todo[one]], into[todo[one]]
        todo, probes = np.delete(todo, one), probes + 1
    byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    value = {int(p): bytes([b]) for b, p in enumerate(byte)}
    raw = [value.get(i, b"" if sp.is_control(i) or sp.is_unknown(i) else text[i].replace(SPACE_MARK, " ").encode()) for i in range(size)]
    by_rank = np.array(sorted(normal, key=order.get), np.int32)
    return Vocabulary(char, joins, keys, ranks, gives, by_rank, probes, size, byte, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def _slot(key: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return ((vec.mix(key.astype(np.uint64)) >> vec.U64(64 - bits)).astype(np.int64) + probe) & ((1 << bits) - 1)


def lookup(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, symbol) of each pair's merge; rank NONE without one."""
    key = (left.astype(np.int64) << 32) | right.astype(np.int64)
    bits = len(v.keys).bit_length() - 1
    slot = _slot(key, 0, bits)
    rank, into = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
    open_ = np.arange(len(key))
    for _ in range(v.probes):
        there = v.keys[slot]
        hit = there == key[open_]
        rank[open_[hit]], into[open_[hit]] = v.rank[slot[hit]], v.into[slot[hit]]
        go = ~hit & (there >= 0)
        if not go.any():
            break
        open_, slot = open_[go], (slot[go] + 1) & (len(v.keys) - 1)
    return rank, into


def _draws(salt: np.ndarray, start: np.ndarray, split: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The keyed hash of candidate merges; a candidate is skipped if it is below the dropout's bound."""
    place = (x.astype(np.uint64) * vec.U64(c) for x, c in zip((start, split, end), PLACE, strict=True))
    return vec.mix(salt + next(place) + next(place) + next(place))


def _merge(v: Vocabulary, sym: np.ndarray, n: np.ndarray, salt: np.ndarray, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Merge the rows of a matrix of symbols (row i has n[i]) step by step, all rows at once.

    Gives the symbols and which of them are left. A symbol keeps the place where it starts; next and
    previous ones are linked. A pair's key is its merge's rank and then its place, so the least key of
    a row is what an agenda would take.
    """
    rows, width = sym.shape
    bits = width.bit_length()
    out, left = sym.T.copy(), np.arange(width)[:, None] < n[None, :]
    keep, step = np.arange(rows), np.arange(width, dtype=np.int32)
    s, lasts, salt = out.copy(), n.astype(np.uint64) + vec.U64(1), salt.astype(np.uint64)
    after = np.where(step[:, None] + 1 < n[None, :], step[:, None] + 1, width).astype(np.int32)
    before = np.tile(np.arange(-1, width, dtype=np.int32)[:, None], (1, rows))  # the last one is written for the end
    key = np.full((width, rows), NONE, np.int32)

    def ranked(r: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Keys of the pairs that start at j."""
        k = after[j, r]
        rank, _ = lookup(v, s[j, r], s[k, r])
        if drop:
            at = np.flatnonzero(rank != NONE)
            end = after[k[at], r[at]].astype(np.uint64)
            end = np.where(end < width, end, lasts[r[at]])
            rank[at[_draws(salt[r[at]], j[at], k[at], end) < drop]] = NONE
        return np.where(rank != NONE, (rank << bits) | j.astype(np.int32), NONE)

    j, r = np.nonzero(step[:, None] + 1 < n[None, :])
    key[j, r] = ranked(r, j)
    while True:
        best = key.min(axis=0) if width else np.zeros(0, np.int32)
        live = np.flatnonzero(best != NONE)
        if 2 * len(live) <= len(keep):  # rows that are done go
            done = np.flatnonzero(best == NONE)
            out[:, keep[done]] = s[:, done]
            if not len(live):
                return out.T, left.T
            s, after, before, key = (m[:, live] for m in (s, after, before, key))
            keep, lasts, salt, best, live = keep[live], lasts[live], salt[live], best[live], np.arange(len(live))
        best = best[live]
        j = best & np.int32((1 << bits) - 1)
        k = after[j, live]
        e = after[k, live]
        s[j, live] = v.by_rank[best >> bits]
        after[j, live] = e
        before[e, live] = j
        left[k, keep[live]] = False
        key[k, live] = NONE
        key[j, live] = NONE
        ok = np.flatnonzero(e < width)
        key[j[ok], live[ok]] = ranked(live[ok], j[ok])
        p = before[j, live]
        ok = np.flatnonzero(p >= 0)
        key[p[ok], live[ok]] = ranked(live[ok], p[ok])


def _agenda(v: Vocabulary, sym: np.ndarray, salt: np.uint64, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long run of symbols: a heap of candidates, so work grows as n log n."""
    n, key, low = len(sym), int(salt), int(drop)
    start = np.arange(n - 1)
    rank, _ = lookup(v, sym[:-1], sym[1:])
    if low:
        rank[_draws(np.full(n - 1, salt), start, start + 1, np.where(start + 2 < n, start + 2, n + 1)) < drop] = NONE
    at = np.flatnonzero(rank != NONE)
    heap = list(zip(rank[at].tolist(), at.tolist(), (at + 1).tolist(), (at + 2).tolist(), strict=True))
    heapq.heapify(heap)
    s, after, before, left, ranks, by_rank = sym.tolist(), list(range(1, n + 1)), list(range(-1, n)), [True] * n, v.pairs(), v.by_rank.tolist()

    def offer(i: int, k: int) -> None:
        r = ranks.get(s[i] << 32 | s[k])
        if r is None:
            return
        e = after[k]
        if low:
            h = (key + i * PLACE[0] + k * PLACE[1] + (e if e < n else n + 1) * PLACE[2]) & M64
            h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & M64
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) & M64
            if h ^ h >> 31 < low:
                return
        heapq.heappush(heap, (r, i, k, e))

    while heap:
        r, i, k, e = heapq.heappop(heap)
        if not left[i] or after[i] != k or after[k] != e or not left[k]:
            continue  # one of the two is part of a longer piece by now
        s[i], after[i], left[k] = by_rank[r], e, False
        before[e] = i
        if e < n:
            offer(i, e)
        if before[i] >= 0:
            offer(before[i], i)
    return np.array(s, np.int32), np.array(left)


def encode(v: Vocabulary, buf: np.ndarray, offs: np.ndarray, keys: np.ndarray | None = None, alpha: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a chunk of texts, joined, and their offsets; keys name the texts for dropout."""
    n_texts = len(offs) - 1
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
    heads = np.flatnonzero(HEAD[buf])
    lead = buf[heads].astype(np.int64)
    width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    pad = np.concatenate((buf, np.zeros(4, np.uint8))).astype(np.int64)
    cp = np.where(width == 1, lead, lead & (0xFF >> (width + 1)))
    for k in (1, 2, 3):
        more = width > k
        cp[more] = (cp[more] << 6) | (pad[heads[more] + k] & 0x3F)
    cp = np.minimum(cp, 0x10FFFF)
    full = np.flatnonzero(np.diff(offs))  # texts with a character get a space in front
    lead_at = np.searchsorted(heads, offs[full])
    cp = np.insert(cp, lead_at, 0x20)
    starts = lead_at + np.arange(len(full))  # of the texts, in symbols
    sym = v.char[cp]
    alone = (sym < 0) | ~v.joins[np.maximum(sym, 0)]
    space = cp == 0x20
    cut = np.zeros(len(cp) + 1, bool)
    cut[starts] = True
    cut[1:-1] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[-1] = True
    at = np.flatnonzero(cut)
    first, last = at[:-1], at[1:]
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(vec.mix(cp.astype(np.uint64)) * vec.powers(len(cp)), out=total[1:])
    h = vec.mix((total[last] - total[first]) * vec.inverses(len(cp) + 1)[first] + (last - first).astype(np.uint64))
    owner = np.searchsorted(starts, first, side="right") - 1  # among the texts with a character
    drop = vec.U64(min(int(alpha * 2.0**64), 2**64 - 1))
    if drop:
        names = keys[full] if keys is not None else full
        turn = first - starts[owner]
        which = vec.mix(vec.mix(names.astype(np.int64).astype(np.uint64) + vec.U64(seed))[owner] + turn.astype(np.uint64))
        h = vec.mix(h + which * vec.U64(0xD6E8FEB86659FD93) + vec.U64(seed * 0x9FB21C651E98DF25 % (1 << 64)))
        unit, one, back = h, np.arange(len(h)), np.arange(len(h))  # every occurrence is a draw of its own
    else:
        unit, one, back = np.unique(h, return_index=True, return_inverse=True)
    a, size = first[one], (last - first)[one]
    order = np.argsort(size, kind="stable")
    sorted_ = size[order]
    out_n = np.zeros(len(unit), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(order):
        wide = int(sorted_[lo])
        top = wide if wide <= 16 else wide + wide // 8
        hi = int(np.searchsorted(sorted_, top, side="right"))
        hi = min(hi, lo + max(1, CELLS // top)) if wide <= LONG else lo + 1
        u = order[lo:hi]
        top = int(size[u[-1]])
        n = size[u].astype(np.int64)
        cells = np.minimum(a[u][:, None] + np.arange(top)[None, :], len(cp) - 1)
        m = sym[cells]
        if wide <= LONG:
            m, in_ = _merge(v, m, n, unit[u], drop)
        else:
            m, in_ = (x[None, :] for x in _agenda(v, m[0], unit[u[0]], drop))
        n = in_.sum(axis=1)
        got, where = m[in_], cells[in_]
        raw = (got < 0) | (got >= v.size)  # characters that are no piece: their bytes
        count = np.ones(len(got), np.int64)
        c = cp[where[raw]]
        count[raw] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]), np.int32)
        flat[ends[~raw] - 1] = got[~raw]
        for x, e, w in zip(c.tolist(), ends[raw].tolist(), count[raw].tolist(), strict=True):
            flat[e - w : e] = v.byte[list(chr(x).encode("utf-8", "surrogatepass"))]
        row = np.repeat(np.arange(len(u)), n)
        own = np.bincount(row, count, len(u)).astype(np.int64)
        out_n[u] = own
        parts.append((u, own, flat))
        lo = hi
    place, flat = np.zeros(len(unit), np.int64), np.concatenate([f for _, _, f in parts])
    skip = 0
    for u, own, f in parts:
        place[u] = skip + np.cumsum(own) - own
        skip += len(f)
    ids, ends = gather(flat, place[back], out_n[back])
    per = np.zeros(n_texts + 1, np.int64)
    bounds = np.append(np.searchsorted(first, starts), len(first))
    per[full + 1] = np.diff(np.concatenate(([0], ends))[bounds])
    return ids, np.cumsum(per)


def gather(flat: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[place[i] : place[i] + count[i]] for all i, joined, and where each ends."""
    ends = np.cumsum(count)
    if not len(ends):
        return flat[:0], ends
    return flat[np.repeat(place - (ends - count), count) + np.arange(int(ends[-1]))], ends


def decode(v: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts from their pieces, and their offsets; the space in front goes."""
    flat, ends = gather(v.flat, v.offs[ids], np.diff(v.offs)[ids])
    at = np.concatenate(([0], ends))[offs]
    full = np.flatnonzero(np.diff(at))
    first = full[flat[at[full]] == 0x20]
    out = np.delete(flat, at[first])
    gone = np.zeros(len(offs), np.int64)
    gone[first + 1] = 1
    return out, at - np.cumsum(gone)


def encode_table(docs: DataFrame, path: str = MODEL, alpha: float = 0.1, seed: int = 20, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (unless with_ids is false), n_pieces, pieces_sha256, decoded_sha256, round_trip."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = shared.value
        text = batch.column(1)
        buf, offs = vec.flat(text)
        for a, b, part, own in vec.chunks(buf, offs, CHUNK):
            keys = batch.column(0).slice(a, b - a)
            ids, ends = encode(v, part, own, np.asarray(keys.fill_null(0)), alpha, seed)
            raw, at = decode(v, ids, ends)
            pieces, whole, same = [], [], []
            src = part.tobytes()
            le, back = ids.astype("<i4").tobytes(), raw.tobytes()
            for i in range(b - a):
                text_i = back[at[i] : at[i + 1]]
                pieces.append(hashlib.sha256(le[4 * ends[i] : 4 * ends[i + 1]]).hexdigest())
                whole.append(hashlib.sha256(text_i).hexdigest())
                same.append(text_i == src[own[i] : own[i + 1]])
            cols = {"doc_id": keys}
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield common.batch_of(**cols, n_pieces=np.diff(ends), pieces_sha256=pa.array(pieces), decoded_sha256=pa.array(whole), round_trip=np.array(same, bool))

    ids = "ids array<int>, " if with_ids else ""
    return common.map_texts(common.id_text(docs), f"doc_id long, {ids}n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean", each)


def decode_table(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    shared = coded.sparkSession.sparkContext.broadcast(load(path))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        ids = np.asarray(lists.flatten(), np.int32)
        offs = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0))))
        raw, at = decode(shared.value, ids, offs)
        yield common.batch_of(doc_id=batch.column(0), text=pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes())).cast(pa.string()))

    return common.map_texts(coded.select("doc_id", "ids"), "doc_id long, text string", each)


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_table(common.table(spark, sf_dir, "documents"), with_ids=False)
