"""Benchmark decontamination by winnowing, with DataFrame functions only.

A benchmark window is WINDOW consecutive words of an item; an item of fewer words is one window.
Words are runs of ASCII letters and digits, A-Z lowered, and of characters above 0x7F. Both sides
hash every GRAM consecutive words and keep, of each WINDOW - GRAM + 1 neighbouring hashes, the least:
two equal windows keep the same fingerprint, so every shared window shows in the join of training
and test fingerprints. Each hit is then extended to the windows around it, which are compared as
words, so the result is exact.

Documents are read once and never shuffled: fingerprints meet the benchmark's in a broadcast join
when these are within bounds of rows and bytes (counted first; beyond, places and hashes are shuffled), and only hits and one small
row a document go through the one exchange on the document's key. Windows of hot items carry the
number of their set of items, not the items. Documents that are equal in id and text are counted
and given back as often. Null texts have no words; null ids are as any other; an empty benchmark
leaves every document clean. Other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 10, 5
SPREAD = WINDOW - GRAM + 1  # neighbouring grams of which the least is kept
#: Windows of the benchmark, and bytes of their words, up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    parts = F.split(low, BREAK)
    skip = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)  # before a break at the start, and after one at the end
    last = F.when((F.size(parts) > skip) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return F.slice(parts, skip + 1, F.size(parts) - skip - last)


def upto(n: Column, size: int) -> Column:
    """0 .. n - size, none if n < size."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def hashed(frame: DataFrame) -> DataFrame:
    """Adds n, word hashes hs and gram hashes gs to a frame with words ws."""
    frame = frame.withColumn("n", F.size("ws")).withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    return frame.withColumn("gs", F.transform(upto(F.col("n"), GRAM), lambda i: gram(i, GRAM)))


def gram(i: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(F.col("hs"), i + j) for j in range(size)))


def kept(frame: DataFrame) -> DataFrame:
    """Adds fs: (size, place, hash) of the grams that some neighbourhood keeps; needs gs."""
    least = lambda i: F.least(*(F.get(F.col("gs"), i + j) for j in range(SPREAD)))
    frame = frame.withColumn("ls", F.transform(upto(F.col("n"), WINDOW), least))
    # a gram is kept if it is the least of a neighbourhood that holds it: the greatest of those minima
    top = lambda i: F.greatest(*(F.get(F.col("ls"), i - j) for j in range(SPREAD)))
    places = F.filter(upto(F.col("n"), GRAM), lambda i: (F.col("n") >= WINDOW) & (F.get(F.col("gs"), i) == top(i)))
    return frame.withColumn("fs", F.transform(places, lambda i: F.struct(F.lit(WINDOW).alias("m"), i.alias("i"), F.get(F.col("gs"), i).alias("h"))))


def prints_of(size: int) -> Column:
    """(size, place, hash) of every gram of a size, for windows of short items."""
    return F.transform(upto(F.col("n"), size), lambda i: F.struct(F.lit(size).alias("m"), i.alias("i"), gram(i, size).alias("h")))


def windows(benchmark: DataFrame) -> DataFrame:
    """(size, key, sid, items): distinct windows as words, and their sets of items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text").cast("string")).alias("ws"))
    items = items.withColumn("m", F.least(F.size("ws"), F.lit(WINDOW))).where("m > 0")
    each = items.select("item", "m", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1)).alias("s"))
    each = each.select("item", "m", F.array_join(F.slice("ws", F.col("s"), F.col("m")), " ").alias("key"))
    sets = each.groupBy("m", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.withColumn("sid", F.sha2(F.concat_ws(",", "items"), 256))


def small(frame: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(frame) if fits else frame


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    wins = common.materialise(windows(benchmark), "bench-windows")
    rows, size = wins.agg(F.count("*"), F.sum(F.octet_length("key") + 100)).first()
    fits = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    short = sorted(r.m for r in wins.where(F.col("m") < WINDOW).select("m").distinct().collect())
    as_words = wins.select("m", F.split("key", " ").alias("ws"))
    # a window of WINDOW words is one neighbourhood: it keeps its least gram
    prints = hashed(as_words).select("m", F.when(F.col("m") == WINDOW, F.array_min("gs")).otherwise(F.xxhash64(*(F.get(F.col("hs"), F.lit(j)) for j in range(WINDOW)))).alias("h"))
    prints = prints.distinct().withColumn("met", F.lit(True))

    base = common.id_text(docs).select(common.ID, F.xxhash64(common.TEXT).alias("th"), words(F.col(common.TEXT)).alias("ws"))
    base = kept(hashed(base))
    one = F.array(F.struct(F.lit(0).alias("m"), F.col("n").alias("i"), F.lit(0).cast("long").alias("h")))  # one row a document, whatever it hits
    extra = [prints_of(m) for m in short]
    found = base.select(common.ID, "th", "ws", "n", F.explode(F.concat(one, "fs", *extra)).alias("f")).select(common.ID, "th", *(["ws"] if fits else []), "n", "f.*")
    found = found.join(small(prints, fits), ["m", "h"], "left").where("m = 0 OR met")
    if not fits:  # only places and hashes were shuffled; the words come to those that met
        texts = base.dropDuplicates([common.ID, "th"]).select(F.col(common.ID).alias("_i"), F.col("th").alias("_t"), "ws")
        found = found.join(texts, F.col(common.ID).eqNullSafe(F.col("_i")) & F.col("th").eqNullSafe(F.col("_t"))).drop("_i", "_t")
    # the windows that hold the gram
    low = F.when(F.col("m") == WINDOW, F.greatest(F.col("i") - (SPREAD - 1), F.lit(0))).otherwise(F.col("i"))
    high = F.when(F.col("m") == WINDOW, F.least(F.col("i"), F.col("n") - WINDOW)).otherwise(F.col("i"))
    near = found.select(common.ID, "th", "m", "i", low.alias("a"), high.alias("b"), F.when(F.col("m") > 0, F.slice("ws", low + 1, F.lit(2 * WINDOW))).alias("ctx"))
    wide = near.select(common.ID, "th", "m", "i", "a", "ctx", F.explode(F.sequence("a", "b")).alias("s"))
    key = F.array_join(F.slice("ctx", F.col("s") - F.col("a") + 1, F.when(F.col("m") > 0, F.col("m")).otherwise(1)), " ")
    wide = wide.select(common.ID, "th", "m", "i", "s", key.alias("key"))
    hits = wide.join(small(wins.select("m", "key", "sid"), fits), ["m", "key"], "left").where("m = 0 OR sid IS NOT NULL")
    per = hits.groupBy(common.ID, "th").agg(
        F.max(F.when(F.col("m") == 0, F.col("i"))).alias("n_words"),
        F.count(F.when(F.col("m") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("m") > 0, F.struct("s", (F.col("s") + F.col("m")).alias("e"))))).alias("spans"),
        F.collect_set("sid").alias("sids"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    walk = lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).alias("n"), F.greatest(x["e"], a["to"]).alias("to"))
    per = per.select(common.ID, "th", "n_words", "copies", F.aggregate("spans", start, walk)["n"].alias("n_hit"), F.explode_outer("sids").alias("sid"))
    sets = wins.groupBy("sid").agg(F.first("items").alias("items"))
    per = per.join(small(sets, fits), "sid", "left").groupBy(common.ID, "th", "n_words", "copies", "n_hit").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    out = per.select(
        common.ID, F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "th", "copies",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that share no window with the benchmark."""
    bad = report(docs, benchmark).where("contaminated").select(F.col(common.ID).alias("_grainmill_i"), F.col("th").alias("_grainmill_t")).distinct()
    return docs.join(bad, docs[common.ID].cast("long").eqNullSafe(F.col("_grainmill_i")) & (F.xxhash64(docs[common.TEXT].cast("string")) == F.col("_grainmill_t")), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("th")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bm AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS key FROM bm, unnest(range(1, len(ws) - m + 2)) AS u(i)),
ms AS (SELECT DISTINCT m FROM w),
g AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS key FROM d, ms, unnest(range(1, len(ws) - m + 2)) AS u(i)),
h AS (SELECT doc_id, i, g.m, item_id FROM g JOIN w USING (m, key)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
