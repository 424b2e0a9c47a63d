"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint's bit is set if it is set in over half the hashes (XXH64, seed 42) of a text's 4-word
shingles. For radius r the bits are mapped to non-zero vectors of r + 1 bits, and table v (one for
each non-zero v) keeps the bits whose vector has odd parity with v. The at most r vectors in which
two fingerprints differ leave some v orthogonal to them all, so every pair within the radius shares
its key in some table: nothing is missed.

Texts are read once. Equal fingerprints are merged before anything else; each distinct one goes to
2^(r+1) - 1 buckets. A bucket of up to BUCKET fingerprints is compared in full and gives a spanning forest,
not pairs. A larger one goes another exact way: two fingerprints are within 4 bits exactly if some
value lies within 2 bits of both, so each is dealt to the values within 2 bits of it, and each value
links those it gets to the least of them: work in proportion to the bucket, dealt by value.

Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows get a row each.
A component's id is its least doc_id; null ids are not counted unless there is no other. An empty
table gives an empty result. Other columns are not read, except to choose among rows equal in id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import common, graph, vec

SHINGLE, RADIUS, BUCKET = 4, 4, 1024
#: For the bit counts: eight lanes of a byte, and how many ones a lane can add up.
LANES, LANE_MAX = vec.U64(0x0101010101010101), 255


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector; bit i has the vector i mod (2^(radius+1) - 1) + 1."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % top + 1) & v).count("1") & 1) for v in range(1, top + 1)]


def shingles(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    h = xxhash.xxh64_intdigest
    return [h(whole[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(h: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    n = len(h)
    if not n:
        return 0
    cut = np.arange(0, n, LANE_MAX)
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((h >> vec.U64(k)) & LANES, cut)
        count = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)  # little-endian: lane j is bit 8 j + k
        for j in np.flatnonzero(2 * count > n):
            out |= 1 << (8 * int(j) + k)
    return out


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. If hashed, th too, the text's hash."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in common.chunked(batch):
            raw = buf.tobytes()
            fps = np.array([majority(np.array(shingles(raw[offs[i] : offs[i + 1]]), np.uint64)) for i in range(len(offs) - 1)], np.uint64)
            more = {"th": rows.column(2)} if hashed else {}
            yield common.batch_of(doc_id=rows.column(0), fp=fps.view(np.int64), **more)

    if hashed:
        return common.map_texts(common.hashed(docs), "doc_id long, fp long, th long", each)
    return common.map_texts(common.id_text(docs), "doc_id long, fp long", each)


def _forest(run: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal buckets that connect what is within the radius."""
    n = len(fp)
    a, b = [], []
    at = np.arange(n - 1) if n else np.arange(0)
    step = 1
    while len(at):
        at = at[at + step < n]
        at = at[run[at] == run[at + step]]
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= radius
        a.append(at[near])
        b.append(at[near] + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = np.flatnonzero(label != np.arange(n))
    return on, label[on]


def links(distinct: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints that give the components of 'within the radius'."""
    spark = distinct.sparkSession
    keep = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks(radius)))
    tables = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks(radius)) - 1))).alias("t"))
    tables = tables.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.get(keep, F.col("t")))).alias("bucket"), "fp")
    dealt = tables.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """hot false: a link (u, v). hot true: u is a member of the too large bucket v."""
        bucket, fp, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def done(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(fp):
                return
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            size = np.diff(np.append(edge, len(bucket)))
            hot = np.repeat((size > limit) | (bucket[edge] == large if large is not None else False), size)
            some = np.repeat(size > 1, size) & ~hot
            f, run = fp[some], bucket[some]
            a, b = _forest(run, f, radius)
            yield common.batch_of(u=f[a].view(np.int64), v=f[b].view(np.int64), hot=np.zeros(len(a), bool))
            if hot.any():
                yield common.batch_of(u=fp[hot].view(np.int64), v=bucket[hot], hot=np.ones(int(hot.sum()), bool))

        for batch in batches:
            bucket = np.concatenate((bucket, np.asarray(batch.column(0))))
            fp = np.concatenate((fp, np.asarray(batch.column(1)).view(np.uint64)))
            if not len(bucket):
                continue
            tail = int(np.searchsorted(bucket, bucket[-1]))  # sorted: the last bucket may go on
            yield from done(bucket[:tail], fp[:tail])
            if large is not None and bucket[tail] != large:
                large = None
            bucket, fp = bucket[tail:], fp[tail:]
            if len(fp) > limit:  # no need to hold it: it goes the other way whole
                large = bucket[0]
                yield common.batch_of(u=fp.view(np.int64), v=bucket, hot=np.ones(len(fp), bool))
                bucket, fp = bucket[:0], fp[:0]
        yield from done(bucket, fp)

    found = common.materialise(common.arrow(dealt, solve, "u long, v long, hot boolean"), "links")
    easy = found.where("NOT hot").select("u", "v")
    hot = found.where("hot").select(F.col("u").alias("fp")).distinct()
    if not hot.limit(1).count():
        return easy
    reach = radius // 2
    ball = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))], np.uint64)
    assert radius == 4 and reach == 2

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for k in range(0, len(fp), 64):
                part = fp[k : k + 64]
                yield common.batch_of(z=(part[:, None] ^ ball[None, :]).ravel().view(np.int64), fp=np.repeat(part, len(ball)).view(np.int64))

    # values that only one member reaches link nothing; the rest are joined with their least member
    reached = common.arrow(hot, near, "z long, fp long")
    least = reached.groupBy("z").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").select(F.col("z").alias("c"), "v")
    return easy.union(reached.join(least, F.col("z") == F.col("c")).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct())


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = common.materialise(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(common.ID).alias("least"))
    roots = graph.components(links(distinct.select("fp")))
    named = distinct.join(common.broadcast_small(roots), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(common.broadcast_small(ids), "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(common.broadcast_small(named), F.col("fp") == F.col("f")).select(common.ID, "fp", "component_id")


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, th, root) for every row; rows with one root are a component."""
    prints = common.materialise(fingerprints(docs, hashed=True), "fingerprints")
    roots = graph.components(links(prints.select("fp").distinct()))
    return prints.join(common.broadcast_small(roots), F.col("fp") == F.col("node"), "left").select(common.ID, "th", F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, near: Callable[[DataFrame], DataFrame] = members) -> DataFrame:
    """One row of each component, all its columns: the least by id (null ids last) and text hash.

    near(docs) gives (doc_id, th, root) for every row of docs. Of rows that are equal in id and text,
    the one with the least hash of all columns stays.
    """
    with scratch.temporary(docs.sparkSession):
        found = common.materialise(near(docs), "members")
        least = F.min(F.struct(F.col(common.ID).isNull().alias("none"), F.col(common.ID).alias("i"), F.col("th").alias("t"))).alias("one")
        many = found.groupBy("root").agg(least, F.count("*").alias("c")).where("c > 1").select(F.col("root").alias("r"), "one.i", "one.t")
        rows = found.join(common.broadcast_small(many), F.col("root") == F.col("r")).groupBy(common.ID, "th", "i", "t").count()
        stays = F.col(common.ID).eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
        marks = rows.where(~stays | (F.col("count") > 1))
        marks = common.materialise(marks.select(F.col(common.ID).alias("_grainmill_i"), F.col("th").alias("_grainmill_t"), stays.alias("_grainmill_s")), "marks", keep=True)
    same = docs[common.ID].cast("long").eqNullSafe(F.col("_grainmill_i")) & F.xxhash64(docs[common.TEXT].cast("string")).eqNullSafe(F.col("_grainmill_t"))
    kept = docs.join(common.broadcast_small(marks), same, "left_anti")
    again = marks.where("_grainmill_s")
    if not again.limit(1).count():
        return kept
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_grainmill_o")
    return kept.unionByName(docs.join(again, same, "left_semi").groupBy(common.ID, F.xxhash64(docs[common.TEXT].cast("string"))).agg(one).select("_grainmill_o.*"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = cluster(common.table(spark, sf_dir, "documents"))
    return found.select(common.ID, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
