"""What the operators share: columns by position, batches of texts, the shared folder, hashes of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import vec

ID, TEXT = "doc_id", "text"
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2500
#: Rows of a few fixed-size columns that may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only the id and the text, whatever else a table holds."""
    return docs.select(docs[ID].cast("long").alias(ID), docs[TEXT].cast("string").alias(TEXT))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, the text's hash."""
    return id_text(docs).withColumn("th", F.xxhash64(TEXT))


Batches = Iterator[pa.RecordBatch]


def arrow(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) by workers that hold few rows at a time and keep little memory after a task.

    Where the session has Spark's own number of rows to a batch, it gets ROWS: a batch of 10,000 texts is tens of
    megabytes in the worker and as much again in the JVM.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, str(ROWS))

    def lean(batches: Batches) -> Batches:
        yield from run(batches)
        vec.trim()

    return df.mapInArrow(lean, schema)


def map_texts(docs: DataFrame, schema: str, each: Callable[[pa.Array, pa.Array], Iterator[list]]) -> DataFrame:
    """each(ids, texts) gives lists of columns for one Arrow batch of (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return arrow(docs, run, schema)


def batch_of(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def chunked(batch: pa.RecordBatch, column: str = TEXT) -> Iterator[tuple[pa.RecordBatch, object, object]]:
    """Parts of a batch with a few megabytes of text each: (rows, bytes, offsets)."""
    buf, offs = vec.flat(batch.column(column))
    for a, b, part, own in vec.chunks(buf, offs):
        yield batch.slice(a, b - a), part, own


def materialise(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    return scratch.written(df, what, keep)


def broadcast_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it was counted and is within bounds; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value written as text, mod n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def labelled(labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """(doc_id, label): at most bound rows of each class, those with the least hashes of their ids.

    Rows whose crc32(doc_id as text) mod folds is held, and null ids or labels, are left out; an id
    labelled twice counts once, by its largest label.
    """
    rows = labels.select(labels[ID].cast("long").alias(ID), labels[label].cast("int").alias("label"))
    rows = rows.where(F.col(ID).isNotNull() & F.col("label").isin(0, 1) & (crc_mod(F.col(ID), folds) != held))
    rows = rows.groupBy(ID).agg(F.max("label").alias("label"))
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64(ID), ID).limit(bound) for k in (0, 1)]
    return parts[0].unionByName(parts[1])
