"""Machinery to find which of many hashed items occur twice or more in a corpus.

Two parts, used by the substring operators:

* a count-min sketch: each task sketches its own items, sketches are merged page by page on the
  executors, and the merged counts (kept up to 2) overestimate, so an item that repeats always
  shows. Its size follows the corpus up to 2^MAX_BITS cells a row, which bounds the broadcast; a
  fuller sketch lets more items through and loses none;
* an exact grouping of the items that are let through: each task packs them into one binary row
  for each hash bucket (so many that a bucket's share of the input is bounded), a bucket is sorted by itself, and the places of repeated items go back to
  their documents packed by document bucket. An item that repeats inside a task is settled there
  and sent once, so a frequent item costs a bucket one entry for each batch of texts, not one a row.

Items are hashes of 64 bits and some more, 88 or 96 in all. Work that is lost with an executor is redone from the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import scratch
from . import common, vec

DEPTH, PAGES, MIN_BITS, MAX_BITS = 2, 64, 16, 29
FLUSH = 1 << 20
SALT = [vec.U64(0x2545F4914F6CDD1D), vec.U64(0x9E6C63D0876A9A47)]


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return vec.mix(h ^ SALT[row]) >> vec.U64(64 - bits)


def _pack(sorted_cells: np.ndarray) -> bytes:
    """Distances between sorted cells, one byte each; 255 stands for a step of 255 without a cell."""
    if not len(sorted_cells):
        return b""
    gap = np.diff(sorted_cells, prepend=sorted_cells.dtype.type(0)).astype(np.int64)
    far = gap // 255
    out = np.full(int(far.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(far + 1) - 1] = gap % 255
    return out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


class Sketch:
    """For each row a bitmap of the cells that were counted twice or more; wrong is the chance that a single item is let through."""

    def __init__(self, bits: int, pages: dict[int, bytes], wrong: float):
        self.bits, self.pages, self.wrong, self.rows = bits, pages, wrong, None

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "pages": self.pages, "wrong": self.wrong, "rows": None}

    def doubt(self, odds: float = 1e-18) -> int:
        """So many items in a row are let through by mistake with these odds only."""
        return int(min(1 << 40, max(4, np.ceil(np.log(odds) / np.log(np.clip(self.wrong, 1e-9, 1 - 1e-12))))))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Indices of the items that may occur twice or more."""
        if self.rows is None:
            size = (1 << self.bits) // 8
            self.rows = [np.zeros(size, np.uint8) for _ in range(DEPTH)]
            for n, page in enumerate(sorted(self.pages)):  # a page goes when it is unpacked: both forms together are twice the memory
                row, k = divmod(page, PAGES)
                self.rows[row][k * (size // PAGES) : (k + 1) * (size // PAGES)] = np.frombuffer(zlib.decompress(self.pages.pop(page)), np.uint8)
                if n % 16 == 15:
                    vec.trim()
        at = np.arange(len(h))
        for row, bitmap in enumerate(self.rows):
            c = cells(h[at], row, self.bits).astype(np.int64)
            at = at[(bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1]
        return at


#: Bytes of text for which there is a bucket at least.
BUCKET_BYTES = 32 << 20


def buckets(docs: DataFrame) -> int:
    """Buckets of hashes, and of documents: two for each shuffle partition, and as many as the input's size asks for."""
    size = docs.agg(F.sum(F.octet_length(common.TEXT))).first()[0] or 0
    return max(2 * parts_of(docs), -(-size // BUCKET_BYTES))


def bits_for(docs: DataFrame, bytes_per_item: float, most: int = MAX_BITS) -> int:
    """Four cells a row for each item that texts of this size hold, between the bounds."""
    size = docs.agg(F.sum(F.octet_length(common.TEXT))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1.0, 4 * size / bytes_per_item))), MIN_BITS, most))


def sketch(rows: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> Sketch:
    """The merged sketch of hashes(bytes, offsets) of every chunk of texts in rows (id, key, text)."""
    shift = bits - (PAGES.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h = np.concatenate(held)
            held.clear()
            page, once, more = [], [], []
            for row in range(DEPTH):
                c = np.empty(len(h), np.uint32)  # a part at a time: whole columns of intermediate values would be most of a worker's memory
                for k in range(0, len(h), 1 << 18):
                    c[k : k + (1 << 18)] = cells(h[k : k + (1 << 18)], row, bits)
                c.sort()
                first = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
                dup = np.unique(c[~first])
                c = c[first]
                for parts, x in ((once, c), (more, dup)):
                    cut = np.append(np.searchsorted(x, np.arange(PAGES, dtype=np.uint32) << np.uint32(shift)), len(x))
                    parts += [_pack(x[cut[k] : cut[k + 1]] - np.uint32(k << shift)) for k in range(PAGES)]
                page += range(row * PAGES, (row + 1) * PAGES)
            yield common.batch_of(page=pa.array(page, pa.int32()), once=pa.array(once, pa.binary()), more=pa.array(more, pa.binary()))

        for batch in batches:
            for _, buf, offs in common.chunked(batch):
                held.append(hashes(buf, offs))
                if sum(map(len, held)) >= 4 * FLUSH:  # more items at once stand closer together, so their distances need fewer bytes
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, twice = None, None, None
        done = lambda: common.batch_of(page=pa.array([now], pa.int32()), bits=pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary()), used=pa.array([int(seen.sum())], pa.int64()))
        for batch in batches:
            for page, once, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if page != now:
                    if now is not None:
                        yield done()
                    now, seen, twice = page, np.zeros(1 << shift, bool), np.zeros(1 << shift, bool)
                c = _unpack(once.as_py())
                twice[c[seen[c]]] = True
                seen[c] = True
                twice[_unpack(more.as_py())] = True
        if now is not None:
            yield done()

    n = min(DEPTH * PAGES, parts_of(rows))
    parts = common.arrow(rows, count, "page int, once binary, more binary").repartition(n, "page").sortWithinPartitions("page")
    pages = common.arrow(parts, merge, "page int, bits binary, used long").collect()
    wrong = float(np.prod([sum(r.used for r in pages if r.page // PAGES == row) / (1 << bits) for row in range(DEPTH)]))
    return Sketch(bits, {r.page: bytes(r.bits) for r in pages}, wrong)


#: Bits of a cell in which counted() counts, and items that a page of these cells has about.
FINE, PAGE_ITEMS = 40, 1 << 21


class Counted:
    """A bitmap in which cells that were counted twice or more are marked, each at so many probes inside its page's part.

    The cells are fine, and only the repeated ones are marked: items that occur once fill nothing, however many there are.
    """

    def __init__(self, pages: int, bits: int, probes: int, parts: dict[int, bytes], wrong: float):
        self.pages, self.bits, self.probes, self.parts, self.wrong, self.bitmap = pages, bits, probes, parts, wrong, None

    doubt = Sketch.doubt

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Indices of the items that may occur twice or more."""
        if self.bitmap is None:
            self.bitmap = np.zeros((1 << self.bits) // 8, np.uint8)
            size = len(self.bitmap) // self.pages
            for n, page in enumerate(sorted(self.parts)):
                self.bitmap[page * size : (page + 1) * size] = np.frombuffer(zlib.decompress(self.parts.pop(page)), np.uint8)
                if n % 256 == 255:
                    vec.trim()
        low, part, found = vec.U64(FINE - (self.pages.bit_length() - 1)), (1 << self.bits) // self.pages, []
        for a in range(0, len(h), vec.BLOCK):
            c = fine(h[a : a + vec.BLOCK])
            at = np.arange(a, a + len(c))
            for k in range(self.probes):
                slot = (c >> low).astype(np.int64) * part + probe(c, k, self.pages, self.bits)
                some = (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                at, c = at[some], c[some]
            found.append(at)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def fine(h: np.ndarray) -> np.ndarray:
    """The cell of an item, whose hash is well mixed already."""
    return h >> vec.U64(64 - FINE)


def probe(c: np.ndarray, k: int, pages: int, bits: int) -> np.ndarray:
    """The k-th place of a fine cell in its page's part of the bitmap."""
    return (vec.mix(c * vec.U64(8) + vec.U64(k + 1)) >> vec.U64(64 - (bits - (pages.bit_length() - 1)))).astype(np.int64)


def counted(rows: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], items: float, most: int = MAX_BITS) -> Counted:
    """As sketch(), for more items than a bitmap has room for: about so many of them.

    Fine cells are counted by their pages' owners, exactly; the bitmap, of 2^most bits at most, is drawn from the
    repeated cells only and gets its size when these are counted. Pages grow in number, not in size.
    """
    pages = 1 << int(np.clip(np.ceil(np.log2(max(1.0, items / PAGE_ITEMS))), 6, 13))
    low = FINE - (pages.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not sum(map(len, held)):
                return
            c = np.concatenate(held)
            held.clear()
            c.sort()
            c = c[np.concatenate((np.ones(min(2, len(c)), bool), c[2:] != c[:-2]))]  # twice says all
            cut = np.searchsorted(c, np.arange(pages + 1, dtype=np.uint64) << vec.U64(low))
            some = np.flatnonzero(np.diff(cut))
            data = [_steps(c[cut[k] : cut[k + 1]] - vec.U64(int(k) << low)) for k in some]
            yield common.batch_of(page=pa.array(some.astype(np.int32)), data=pa.array(data, pa.binary()))

        for batch in batches:
            for _, buf, offs in common.chunked(batch):
                held.append(fine(hashes(buf, offs)))
                if sum(map(len, held)) >= 4 * FLUSH:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                c = np.concatenate(held)
                held.clear()
                c.sort()
                same = c[1:] == c[:-1]
                twice = np.unique(c[1:][same])
                yield common.batch_of(page=pa.array([now], pa.int32()), n=pa.array([len(twice)], pa.int64()), used=pa.array([len(c) - int(same.sum())], pa.int64()), data=pa.array([_steps(twice)], pa.binary()))

        for batch in batches:
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if page != now:
                    yield from flush()
                    now = page
                held.append(_unsteps(data.as_py()))
        yield from flush()

    parts = common.arrow(rows, count, "page int, data binary").repartition(min(pages, parts_of(rows)), "page").sortWithinPartitions("page")
    with scratch.temporary(rows.sparkSession):
        found = common.materialise(common.arrow(parts, merge, "page int, n long, used long, data binary"), "cells")
        n, used = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("used"), F.lit(0))).first()
        bits = max(int(np.clip(np.ceil(np.log2(max(1, 12 * n))), MIN_BITS, most)), pages.bit_length() + 2)
        probes = int(np.clip(np.round(np.log(2) * (1 << bits) / max(1, n)), 1, 4))

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for page, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                    c, marked = _unsteps(data.as_py()) + vec.U64(page << low), np.zeros((1 << bits) // pages, bool)
                    for k in range(probes):
                        marked[probe(c, k, pages, bits)] = True
                    yield common.batch_of(page=pa.array([page], pa.int32()), bits=pa.array([zlib.compress(np.packbits(marked, bitorder="little").tobytes(), 1)], pa.binary()), marked=pa.array([int(marked.sum())], pa.int64()))

        drawn = common.arrow(found.where("n > 0"), draw, "page int, bits binary, marked long").collect()
    wrong = (sum(r.marked for r in drawn) / (1 << bits)) ** probes + used / (1 << FINE)
    return Counted(pages, bits, probes, {r.page: bytes(r.bits) for r in drawn}, wrong)


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key tells rows apart unless they are equal in id and text."""
    rows = common.id_text(docs)
    return rows.select(common.ID, F.xxhash64(common.ID, common.TEXT).alias("key"), common.TEXT)


def home(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("int")


# ---- packed rows -------------------------------------------------------------------------------


def _low(x: np.ndarray, size: int) -> bytes:
    """The low bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(data: bytes, at: int, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").ravel()


def _size(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def _steps(x: np.ndarray) -> bytes:
    """Sorted values as steps of as many bytes as the largest needs."""
    step = np.diff(x, prepend=np.uint64(0))
    return bytes([_size(step)]) + _low(step, _size(step))


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data, 1, (len(data) - 1) // data[0], data[0]), dtype=np.uint64)


def pack_items(h1: np.ndarray, h2: np.ndarray, ask: np.ndarray, key: np.ndarray, pos: np.ndarray) -> bytes:
    """Items in order of h1, which is kept as steps, and the key and place of those that ask.

    Every column takes the bytes that its largest value needs.
    """
    keys, at = np.unique(key[ask], return_inverse=True)
    step = np.diff(h1, prepend=np.uint64(0))
    step[:1] = 0
    cols = (step, h2, pos[ask].astype(np.uint64), at.astype(np.uint64))
    sizes = [_size(c) for c in cols]
    head = np.array([len(h1), len(at), len(keys), int(h1[0]) - (1 << 63) if len(h1) else 0, *sizes], np.int64)
    return b"".join((head.tobytes(), keys.astype(np.int64).tobytes(), np.packbits(ask).tobytes(), *(_low(c, k) for c, k in zip(cols, sizes, strict=True))))


def unpack_items(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, k, first, *sizes = (int(x) for x in np.frombuffer(data, np.int64, 8))
    keys = np.frombuffer(data, np.int64, k, 64)
    at = 64 + 8 * k
    ask = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    at, cols = at + (n + 7) // 8, []
    for size, rows in zip(sizes, (n, n, m, m), strict=True):
        cols.append(_wide(data, at, rows, size))
        at += rows * size
    step, h2, pos, local = cols
    key, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    key[ask], place[ask] = keys[local.astype(np.int64)], pos.astype(np.int64)
    return np.cumsum(step, dtype=np.uint64) + np.uint64(first + (1 << 63)), h2, ask, key, place


def pack_places(key: np.ndarray, pos: np.ndarray) -> bytes:
    """Distinct places as runs (start, length) for each key."""
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order].astype(np.int64)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (pos[1:] > pos[:-1] + 1)))
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(key)) - 1
    return pack_runs(key[start], pos[start], pos[last] - pos[start] + 1)


def pack_runs(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    head = np.array([len(key)], np.int64)
    return b"".join(x.tobytes() for x in (head, key.astype(np.int64), start.astype(np.uint32), size.astype(np.uint32)))


def unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n), np.frombuffer(data, np.uint32, n, 8 + 12 * n)


def _same(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal items stand together, and whether each is equal to the one before."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    tie = a[1:] == a[:-1]
    if (tie & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        tie = a[1:] == a[:-1]
    return order, np.concatenate(([False], tie & (b[1:] == b[:-1])))


def by_home(key: np.ndarray, n: int, *cols: np.ndarray, pack: Callable[..., bytes] = pack_places) -> Iterator[tuple[int, bytes]]:
    """Places packed for each document bucket."""
    if not len(key):
        return
    bucket = key % n  # numpy's and pmod's remainders have the divisor's sign
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cut)):
        at = order[cut[k] : cut[k + 1]]
        yield int(k), pack(key[at], *(c[at] for c in cols))


class Items:
    """Items of a chunk: 64 bits and some more, and for those that ask whether they repeat their text's number and place.

    The others only answer. runs (text, start, length) are places that need no answer.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, text: np.ndarray, pos: np.ndarray, ask: np.ndarray | None = None, runs: tuple | None = None):
        self.h1, self.h2, self.text, self.pos, self.runs = h1, h2, text, pos, runs
        self.ask = np.ones(len(h1), bool) if ask is None else ask


def exact(rows: DataFrame, items: Callable[[np.ndarray, np.ndarray], Items], n: int) -> DataFrame:
    """(bucket, places): where the items of rows (id, key, text) that ask and occur twice or more are, and the runs.

    n is the number of document buckets, and of hash buckets.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        runs: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            if runs:
                out += [(False, b, p) for b, p in by_home(*_runs(runs), pack=pack_runs)]
                runs.clear()
            if held:
                h1, h2, ask, key, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order, same = _same(h1, h2)
                many = np.zeros(len(h1), bool)
                many[order[same | np.append(same[1:], False)]] = True
                told = many & ask  # settled here
                out += [(False, b, p) for b, p in by_home(key[told], n, pos[told])]
                ask = ask & ~many
                one = order[~same]  # sorted by the first hash: a bucket is a range of its top bits
                cut = np.searchsorted(h1[one], np.array([(k << 64) // n for k in range(1, n)], np.uint64))
                for k, at in enumerate(np.split(one, cut)):
                    if len(at):
                        out.append((True, k, pack_items(h1[at], h2[at], ask[at], key[at], pos[at])))
            for k in range(0, len(out), 64):
                part = list(zip(*out[k : k + 64], strict=True))
                yield common.batch_of(ask=pa.array(part[0]), bucket=pa.array(part[1], pa.int32()), data=pa.array(part[2], pa.binary()))

        def _runs(runs: list[tuple]) -> tuple:
            key, start, size = (np.concatenate(x) for x in zip(*runs, strict=True))
            return key, n, start, size

        for batch in batches:
            for part, buf, offs in common.chunked(batch):
                found, keys = items(buf, offs), np.asarray(part.column(1))
                if len(found.h1):
                    held.append((found.h1, found.h2, found.ask, keys[found.text], found.pos))
                if found.runs is not None and len(found.runs[0]):
                    runs.append((keys[found.runs[0]], *found.runs[1:]))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:  # an item of one batch only is settled already
                h1, h2, ask, key, pos = (np.concatenate(x) for x in zip(*map(unpack_items, held), strict=True))
                order, same = _same(h1, h2)
                many = order[same | np.append(same[1:], False)]
                many = many[ask[many]]
                for b, p in by_home(key[many], n, pos[many]):
                    yield common.batch_of(bucket=pa.array([b], pa.int32()), places=pa.array([p], pa.binary()))
            held.clear()

        for batch in batches:
            for ask, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not ask:
                    yield common.batch_of(bucket=pa.array([bucket], pa.int32()), places=pa.array([data.as_py()], pa.binary()))
                    continue
                if bucket != now:
                    yield from flush()
                    now = bucket
                held.append(data.as_py())
        yield from flush()

    sent = common.arrow(rows, send, "ask boolean, bucket int, data binary").repartition(max(parts_of(rows), n // 2), "bucket").sortWithinPartitions("ask", "bucket")
    return common.arrow(sent, settle, "bucket int, places binary")


def equal_texts(rows: DataFrame, size: int, n: int) -> tuple[DataFrame, DataFrame]:
    """What texts that are equal as wholes settle without their windows.

    (key, spare): the rows with an equal text elsewhere; all but one of a group are spare, as the one
    stands for the text in every further step. (bucket, places): for texts of size units or more,
    every start, since each window has its like in the copy. Only hashes and lengths are shuffled.
    """
    text = F.col(common.TEXT)
    small = rows.select("key", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.octet_length(text).cast("long").alias("n"))
    small = common.materialise(small, "texts")
    groups = small.groupBy("t1", "t2", "n").agg(F.count("*").alias("c"), F.min("key").alias("rep")).where("c > 1 AND n IS NOT NULL")
    members = common.materialise(small.join(common.broadcast_small(groups), ["t1", "t2", "n"]).select("key", "n", (F.col("key") != F.col("rep")).alias("spare")).distinct(), "copies")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, length = (np.asarray(batch.column(k)) for k in (0, 1))
            for b, p in by_home(key, n, np.zeros(len(key), np.int64), length - size + 1, pack=pack_runs):
                yield common.batch_of(bucket=pa.array([b], pa.int32()), places=pa.array([p], pa.binary()))

    return members.select("key", "spare"), members.where(F.col("n") >= size).select("key", "n").mapInArrow(whole, "bucket int, places binary")


def beside(rows: DataFrame, small: DataFrame) -> DataFrame:
    """A left join on the key, by broadcast only where the small side was counted and is within bounds."""
    return rows.join(common.broadcast_small(small), "key", "left")


Each = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, dict[int, np.ndarray]], pa.RecordBatch]


def applied(docs: DataFrame, places: DataFrame, n: int, each: Each, schema: str, clean: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, known: DataFrame | None = None) -> DataFrame:
    """each(rows, bytes, offsets, places) for chunks of rows (rest, key), with the places by key.

    rest is a struct of the columns besides the text. Texts, compressed, and the places found in them
    are dealt by document bucket; a bucket's places come first and are held while its texts stream
    past. Texts that clean(bytes, offsets) is true for have no places: they are done where they are
    read, unless known (key, spare) has their key, and only their results go the same way.
    """
    rest = F.struct(*(docs[c] for c in docs.columns if c != common.TEXT))
    key = F.xxhash64(docs[common.ID].cast("long"), docs[common.TEXT].cast("string"))
    rows = docs.select(rest.alias("rest"), key.alias("key"), docs[common.TEXT].cast("string").alias("t"))
    rows = beside(rows, known) if known is not None else rows.withColumn("spare", F.lit(None).cast("boolean"))
    rows = rows.select("rest", "key", "t", F.col("spare").isNotNull().alias("copy"))
    kind = rows.schema["rest"].dataType.simpleString()

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, buf, offs in common.chunked(batch, "t"):
                home_ = (np.asarray(part.column(1)) % n).astype(np.int32)
                is_clean = clean(buf, offs) & ~np.asarray(part.column(3).cast(pa.uint8())).astype(bool) if clean else np.zeros(len(offs) - 1, bool)
                at = np.flatnonzero(is_clean)
                if len(at):
                    some = part.take(pa.array(at))
                    out = each(some, *vec.flat(some.column(2)), {})
                    empty = [pa.nulls(len(at), t) for t in (pa.bool_(), some.column(0).type, pa.int64(), pa.binary(), pa.bool_())]
                    yield pa.RecordBatch.from_arrays([pa.array(home_[at]), *empty, pa.StructArray.from_arrays(out.columns, names=out.schema.names)], names=names)
                at = np.flatnonzero(~is_clean)
                if len(at):
                    some, raw = part.take(pa.array(at)), buf.tobytes()
                    packed = pa.array([zlib.compress(raw[offs[i] : offs[i + 1]], 1) for i in at], pa.binary())
                    cols = [pa.array(home_[at]), pa.array(np.ones(len(at), bool)), some.column(0), some.column(1), packed, some.column(2).is_null()]
                    yield pa.RecordBatch.from_arrays([*cols, *([pa.nulls(len(at), result)] if clean else [])], names=names)

    names, result = ["b", "is_doc", "rest", "key", "p", "is_null"], None
    if clean:
        names, result = [*names, "done"], pa.struct(to_arrow_schema(StructType.fromDDL(schema)))
    texts = common.arrow(rows, sort_out, f"b int, is_doc boolean, rest {kind}, key long, p binary, is_null boolean" + f", done struct<{schema}>" * bool(clean))
    found = places.select(F.col("bucket").alias("b"), F.lit(False).alias("is_doc"), F.lit(None).cast(kind).alias("rest"), F.lit(None).cast("long").alias("key"), F.col("places").alias("p"), F.lit(None).cast("boolean").alias("is_null"))
    if clean:
        found = found.withColumn("done", F.lit(None).cast(f"struct<{schema}>"))
    dealt = texts.union(found).repartition(max(parts_of(docs), n // 2), "b").sortWithinPartitions("b", "is_doc")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, by_key = None, [], {}
        for batch in batches:
            if batch.column(1).null_count:
                done = batch.column(1).is_null()
                yield pa.RecordBatch.from_arrays(batch.column(6).filter(done).flatten(), names=result.names)
                batch = batch.filter(pc.invert(done))
            if not batch.num_rows:
                continue
            bucket, is_doc = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.uint8()))
            edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (is_doc[1:] != is_doc[:-1]))))
            for a, b in zip(edge, np.append(edge[1:], batch.num_rows), strict=True):
                if bucket[a] != now:
                    now, held, by_key = bucket[a], [], {}
                if not is_doc[a]:
                    held += [unpack_places(x.as_py()) for x in batch.column(4).slice(a, b - a)]
                    continue
                if held:
                    k, start, size = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(k, kind="stable")
                    cut = np.flatnonzero(np.diff(k[order])) + 1
                    by_key, held = {int(k[g[0]]): np.stack((start[g], size[g])).astype(np.int64) for g in np.split(order, cut)}, []
                for c in range(a, b, 512):
                    part = batch.slice(c, min(512, b - c))
                    texts = [None if empty else zlib.decompress(x.as_py()) for x, empty in zip(part.column(4), part.column(5).to_pylist(), strict=True)]
                    column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
                    rows_ = pa.RecordBatch.from_arrays([part.column(2), part.column(3), column], names=["rest", "key", "t"])
                    for some, buf, offs in common.chunked(rows_, "t"):
                        yield each(some, buf, offs, by_key)

    return common.arrow(dealt, meet, schema)


def covered(found: np.ndarray | None, size: int, n: int) -> np.ndarray:
    """Which of n units the windows of size units cover whose starts are found, as (starts, numbers of starts)."""
    edge = np.zeros(n + 1, np.int32)
    if found is not None:
        np.add.at(edge, found[0], 1)
        np.add.at(edge, np.minimum(found[0] + found[1] + size - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0
