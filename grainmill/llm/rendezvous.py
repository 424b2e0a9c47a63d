"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard s draws u(key, s) in (0, 1) from a hash; the key goes to the shard with the least
-ln(u) / weight. A shard that is added only wins keys for itself, so growing from n to n + 1 shards
moves about 1 / (n + 1) of the rows, all of them into the new shard, and nothing between old ones.

Slots number each shard's rows without gaps. A shard is cut into fixed parts by a hash of the key and
the text's CRC; the parts' counts are summed up (a table of shards x parts rows, whatever the input) and
rows are numbered inside their part. Rows that are equal in all columns are counted before they are
shuffled and numbered together, so no task sorts a whole shard or a frequent key, and no text is shuffled.

Null texts have size 1 and the CRC of no bytes; null keys count as the key 'null'. Rows that are the
same in all three columns get one slot each, in any order. An empty table gives an empty result.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hex digits of the key's hash that choose the part of a shard: 16^3 parts.
PART_DIGITS = 3


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard from 0 that wins the key."""
    draws = []
    for s, weight in enumerate(weights):
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{s}")).cast("binary")), 1, 13)
        u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(s).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard once a shard of weight added joins."""
    key = F.coalesce(F.col(common.ID).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(common.TEXT), F.lit("")).cast("binary")
    part = F.substring(F.md5(F.concat(key, F.lit(":"), F.crc32(text).cast("string")).cast("binary")), 1, PART_DIGITS)
    rows = common.id_text(docs).select(
        common.ID,
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        part.alias("part"),
        shard_of(key, [*weights, added]).alias("grown_shard"),
    )
    counts = rows.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("skip"))
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    place = F.sum("copies").over(Window.partitionBy("shard", "part").orderBy(common.ID, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("place", F.coalesce(place, F.lit(0))).join(F.broadcast(offsets), ["shard", "part"])
    first = (F.col("skip") + F.col("place")).cast("long")
    return same.select(common.ID, "size", "text_crc32", "law", "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard")


def op5_rendezvous(spark, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents"), [1.0] * 8)


ORACLE = """
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS x FROM documents),
c AS (
  SELECT d.*, strlen(x) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: ('0x' || b)::BIGINT),
             lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS crc
  FROM d, tab),
s AS (
  SELECT doc_id, k, s, -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496) AS draw
  FROM d, range(9) AS r(s)),
a AS (SELECT k, arg_min(s, draw) FILTER (s < 8) AS shard, arg_min(s, draw) AS grown FROM s GROUP BY k)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, grown::INT AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || ':' || crc), 1, 3), doc_id, size, crc) - 1 AS slot
FROM c JOIN a USING (k)
"""
