"""WARC fixity audit with Merkle trees.

Records of two replicas are hashed, and each replica gets a tree over ordered offset ranges. A leaf is a
record: its length and SHA-256. A node holds its up to FANOUT children in order, each with the offset
range it takes in the node, and hashes all of that; first within a file and then over files. An audit
compares the roots and descends only below nodes that differ: equal branches are not looked into, and
a damaged record's offset in its file is what the ranges on its path add up to.

A file holds the records whose ids fall in one range of ids, and nodes are ranges of ids, so that they are the same in
both replicas; offsets count from the node's own begin, so a lost or added record changes only the
nodes above it. Ids below 0, from 0 on and null have a root each. Ids far apart share few nodes, and then
a level has as many nodes as there are records, up to 16 levels for ids of 64 bits.

Records with one id, if repeated, are hashed together in any order. Null urls and bodies count as empty.
An empty replica has no root, and every record of the other is then reported. Bodies of any length are
hashed whole. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import common

FANOUT = 16
FILE_LEVELS = 3  # a file covers FANOUT^3 ids


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(pages: DataFrame) -> DataFrame:
    """(id, node, hash, length, copies): node is the leaf's number, ids in order, and null for a null id."""
    page_id = pages["page_id"].cast("long")
    rows = pages.select(page_id.alias("id"), record(page_id, pages["url"].cast("string"), pages["html"].cast("string")).alias("r"))
    rows = rows.select("id", F.sha2("r", 256).alias("h"), F.octet_length("r").cast("long").alias("n"))
    # one row an id; hashes of a repeated id are added up lane by lane, which needs no order and no list
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"l{k}") for k in range(4)]
    one = rows.groupBy("id").agg(F.max("h").alias("h"), F.sum("n").alias("length"), F.count("*").alias("copies"), *lanes)
    sums = F.concat_ws(":", "copies", *(F.col(f"l{k}").cast("string") for k in range(4)))
    whole = F.when(F.col("copies") == 1, F.col("h")).otherwise(F.sha2(sums, 256))
    return one.select("id", F.col("id").alias("node"), whole.alias("hash"), "length", "copies")


def above(node: Column) -> Column:
    return F.shiftright(node, FANOUT.bit_length() - 1)  # rounds down, below 0 too


def up(level: DataFrame) -> DataFrame:
    """The level above: (node, hash, length, kids), kids with their numbers, offsets in the node, lengths and hashes."""
    kids = F.array_sort(F.collect_list(F.struct("node", "length", "hash")))
    rows = level.groupBy(above(F.col("node")).alias("node")).agg(kids.alias("k"), F.sum("length").alias("length"))
    before = lambda i: F.aggregate(F.slice("k", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    rows = rows.withColumn("kids", F.transform("k", lambda x, i: F.struct(x["node"].alias("node"), before(i).alias("at"), x["length"].alias("length"), x["hash"].alias("hash"))))
    text = F.concat_ws(";", F.transform("kids", lambda x: F.concat_ws(":", x["node"].cast("string"), x["at"].cast("string"), x["length"].cast("string"), x["hash"])))
    return rows.select("node", F.sha2(text, 256).alias("hash"), "length", "kids")


def tree(pages: DataFrame, name: str, levels: int = FILE_LEVELS) -> list[DataFrame]:
    """Levels from the leaves up to the roots, each written in the shared folder; driver work is one look at each."""
    out = [common.materialise(leaves(pages).select("node", "hash", "length"), f"merkle-{name}-0")]
    while len(out) <= levels or out[-1].where("node NOT IN (0, -1)").limit(1).count():
        out.append(common.materialise(up(out[-1]), f"merkle-{name}-{len(out)}"))
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record that differs: page_id, status, file, offset in the primary's file, length, hashes."""
    with scratch.temporary(primary.sparkSession):
        a = tree(primary, "a")
        b = tree(replica, "b", len(a) - 1)
        if len(b) > len(a):
            a += [common.materialise(x, f"merkle-a-{k}") for k, x in enumerate(_higher(a[-1], len(b) - len(a)), len(a))]
        return common.materialise(_descended(a, b), "merkle-found", keep=True)


def _higher(level: DataFrame, n: int) -> list[DataFrame]:
    out = [level]
    for _ in range(n):
        out.append(up(out[-1]))
    return out[1:]


def _descended(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    x, y = (t[-1].select(F.col("node").alias(f"n{s}"), F.col("hash").alias(s)) for t, s in ((a, "ha"), (b, "hb")))
    found = x.join(y, F.col("nha").eqNullSafe(F.col("nhb")), "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
    found = found.select(F.coalesce("nha", "nhb").alias("node"), F.lit(0).cast("long").alias("off"))
    for k in range(len(a) - 1, 0, -1):
        kind = a[k].schema["kids"].dataType.simpleString()
        x, y = (t[k].select(F.col("node").alias(f"n{s}"), F.col("kids").alias(s)) for t, s in ((a, "ka"), (b, "kb")))
        both = found.join(x, F.col("node").eqNullSafe(F.col("nka")), "left").join(y, F.col("node").eqNullSafe(F.col("nkb")), "left")
        none = F.array().cast(kind)
        both = both.select("off", F.coalesce("ka", none).alias("ka"), F.coalesce("kb", none).alias("kb"))
        both = both.select("*", F.explode(F.array_union(F.transform("ka", lambda q: q["node"]), F.transform("kb", lambda q: q["node"]))).alias("node"))
        pa_, pb = (F.get(F.filter(c, lambda q: q["node"].eqNullSafe(F.col("node"))), F.lit(0)) for c in ("ka", "kb"))
        ahead = F.aggregate(F.filter("ka", lambda q: q["node"] < F.col("node")), F.lit(0).cast("long"), lambda s, q: s + q["length"])
        off = F.col("off") + ahead if k <= FILE_LEVELS else F.lit(0).cast("long")
        found = both.select("node", off.alias("off"), pa_["length"].alias("length"), pa_["hash"].alias("ha"), pb["hash"].alias("hb"))
        found = found.where(~F.col("ha").eqNullSafe(F.col("hb")))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("corrupt")
    return found.select(
        F.col("node").alias("page_id"), status.alias("status"), F.shiftright("node", FILE_LEVELS * (FANOUT.bit_length() - 1)).alias("file"),
        F.col("off").alias("offset"), F.col("length").cast("long").alias("length"), F.col("ha").alias("primary_sha256"), F.col("hb").alias("replica_sha256"),
    )


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known damage, by md5 of the id: bodies with a changed end, and records that are lost."""
    code = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    html = F.when(code == "0a", F.concat(F.coalesce(F.col("html"), F.lit("")), F.lit("?"))).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"), code.alias("code")).where(F.col("page_id").isNull() | (F.col("code") != "0b")).drop("code")


def op2_merkle(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged_copy(pages))


ORACLE = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, substr(md5(page_id::VARCHAR), 1, 2) AS code FROM pages),
f AS (
  SELECT page_id, code, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Length: ' AS head, h, repeat(chr(13) || chr(10), 2) AS gap FROM r),
a AS (
  SELECT page_id, code, page_id // 4096 AS file, head || strlen(h) || gap || h || gap AS rec,
         head || (strlen(h) + 1) || gap || h || '?' || gap AS bad FROM f),
o AS (
  SELECT *, strlen(rec)::BIGINT AS length,
         coalesce(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM a)
SELECT page_id, CASE WHEN code = '0a' THEN 'corrupt' ELSE 'missing' END AS status, file::BIGINT AS file, off AS "offset", length,
       sha256(rec) AS primary_sha256, CASE WHEN code = '0a' THEN sha256(bad) END AS replica_sha256
FROM o WHERE code IN ('0a', '0b')
"""
