"""Incremental work: pending rows against done rows, and the same as a checkpointed stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that aren't done yet."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def resume(all_rows: DataFrame, done: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """The next rows of a request budget, in order: the budget is the feature."""
    return pending(all_rows, done, key).orderBy(order).limit(budget)


def stream(spark: SparkSession, schema, source: str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 1):
    """Run new files of a folder through a step into a sink, once each, until none are left."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return step(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window with a watermark, for streams and batches."""
    counted = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = counted.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def usage(df: DataFrame, model: str, prompt: str, answer: str, price_in: float, price_out: float) -> DataFrame:
    """Tokens and their cost by model, at prices for a million."""
    cost = (F.sum(prompt) * price_in + F.sum(answer) * price_out) / 1_000_000
    return df.groupBy(model).agg(F.sum(prompt).alias("prompt_tokens"), F.sum(answer).alias("answer_tokens"), cost.alias("cost"))


def refine(points: DataFrame, find: Callable[[DataFrame], DataFrame], narrow: Callable[[DataFrame], DataFrame], group: list[str], item: str, least: int, rounds: int) -> DataFrame:
    """Search, then search again around the groups that are saturated; all finds, each once."""
    found, todo = None, points
    for _ in range(rounds):
        got = find(todo)
        found = got if found is None else found.unionByName(got)
        full = got.groupBy(*group).agg(F.count_distinct(item).alias("_n")).where(F.col("_n") >= least).select(*group)
        todo = narrow(full)
    return found.select(item).distinct()


def any_pending(all_rows: DataFrame, done: DataFrame, key: str, recalculate: bool = False) -> bool:
    """Whether there is work: a row that isn't done, or any row if all is to be done again."""
    return bool((all_rows if recalculate else pending(all_rows, done, key)).limit(1).count())


def save_now(k: int, total: int, spent: int, budget: int, every: int = 200) -> bool:
    """Whether to store what was found after request k of total: each so many, the last one, and when the budget ends."""
    return k % every == 0 or k == total - 1 or spent >= budget - 1


def search(spark: SparkSession, points: DataFrame, key: str, find: Callable[[DataFrame], DataFrame], folder: str, budget: int, every: int = 200) -> tuple[DataFrame, DataFrame]:
    """(found, done): search around points in order of their key, so many at a time, until none is left or the budget is spent.

    What is found and which points are done is appended in a folder after each step, so a later call goes on
    where one ended or broke off; a step that broke off between the two is done again, and its finds
    count once.
    """
    found, done = f"{folder}/found", f"{folder}/done"
    none = points.select(key).limit(0)
    none.write.mode("append").parquet(done)
    find(points.limit(0)).write.mode("append").parquet(found)
    while budget > 0:
        step = min(every, budget)
        rows = resume(points, spark.read.schema(none.schema).parquet(done), key, key, step).persist()
        n = rows.count()
        if n:
            find(rows).write.mode("append").parquet(found)
            rows.select(key).write.mode("append").parquet(done)
        rows.unpersist()
        budget -= n
        if n < step:
            break
    got = spark.read.schema(find(points.limit(0)).schema).parquet(found).distinct()
    return got, spark.read.schema(none.schema).parquet(done)
