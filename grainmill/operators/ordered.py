"""Global order without a one-task window.

A column is cut at approximate quantiles into ranges (a bounded number of edges, the only thing that
reaches the driver); ranges are summed up, and rows or distinct values are numbered inside their
range and shifted by what comes before. Ranks, running totals and positions over a whole table then
use every core and spill like any other window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges_of(df: DataFrame, column: str, parts: int) -> list[float]:
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(found or []))


def range_id(column: Column, edges: list[float]) -> Column:
    """How many edges are at or below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= column.cast("double")))


def value_positions(df: DataFrame, column: str, parts: int = 32) -> DataFrame:
    """(value, n, before, distinct_before): for each distinct value its rows, and rows and values below it."""
    edges = edges_of(df, column, parts)
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("part", range_id(F.col("value"), edges))
    totals = counts.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("values"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range: at most parts rows
    skip = totals.select("part", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("rows0"), F.coalesce(F.sum("values").over(w), F.lit(0)).alias("values0"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(F.broadcast(skip), "part")
    return out.select(
        "value", "n",
        (F.col("rows0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"),
        (F.col("values0") + F.coalesce(F.count("n").over(inside), F.lit(0))).alias("distinct_before"),
    )


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it was counted and is within bounds; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def quantiles(df: DataFrame, column: str, points: Sequence[float], by: Sequence[str] = (), name: str = "quantiles") -> DataFrame:
    """(by, name): an array of the exact, linearly interpolated quantiles of each group, or of the whole table as one row.

    Values are counted before they are shuffled and ranked by a window that spills (over a whole table by
    ranges), so no buffer holds a group's values. Nulls are left out; a group without values has null quantiles.
    """
    value = F.col(column).cast("double")
    if by:
        counts = df.groupBy(*by, value.alias("_v")).agg(F.sum(F.when(value.isNotNull(), 1).otherwise(0)).alias("_m"))
        w = Window.partitionBy(*by).orderBy("_v")
        rows = counts.withColumns({"_top": F.sum("_m").over(w), "_n": F.sum("_m").over(Window.partitionBy(*by))}).where("_v IS NOT NULL OR _n = 0")
    else:
        place = value_positions(df.select(value.alias("_v")), "_v")
        rows = place.select(F.col("value").alias("_v"), (F.col("before") + F.col("n")).alias("_top")).crossJoin(F.broadcast(place.agg(F.sum("n").alias("_n"))))

    def one(p: float, up: bool) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        return F.min(F.when(F.col("_top") > (F.ceil(at) if up else F.floor(at)), F.col("_v")))

    ends = [F.struct(one(p, False).alias("a"), one(p, True).alias("b"), F.max(F.lit(float(p)) * (F.col("_n") - 1) % 1).alias("f")) for p in points]
    found = rows.groupBy(*by).agg(F.array(*ends).alias("_e"))
    return found.select(*by, F.transform("_e", lambda e: e["a"] + (e["b"] - e["a"]) * e["f"]).alias(name))


def ranked(df: DataFrame, column: str, method: str = "average", ascending: bool = True, name: str = "rank", tie: str | None = None) -> DataFrame:
    """Rank a whole table by a numeric column: average, min, max, dense, or first (ties by another column). Nulls stay null."""
    source = df if ascending else df.withColumn("_neg", -F.col(column))
    key = column if ascending else "_neg"
    place = value_positions(source, key)
    low, high = F.col("before") + 1, F.col("before") + F.col("n")
    rank = {"average": (low + high) / F.lit(2.0), "min": low, "max": high, "dense": F.col("distinct_before") + 1, "first": F.col("before")}[method]
    place = place.select(F.col("value").alias("_v"), rank.alias(name))
    out = source.join(place, F.col(key) == F.col("_v"), "left").drop("_v", *([] if ascending else ["_neg"]))
    if method == "first":
        among = F.row_number().over(Window.partitionBy(column).orderBy(tie))
        out = out.withColumn(name, F.when(F.col(column).isNotNull(), F.col(name) + among))
    return out
