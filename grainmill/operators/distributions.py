"""Histograms, densities, box statistics and errors of means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def histogram(df: DataFrame, column: str, bins: int, density: bool = False, weight: str | None = None) -> DataFrame:
    """(bin, n): left-closed bins of one width, the last closed on both sides; density integrates to 1."""
    ends = F.broadcast(df.agg(F.min(column).alias("_a"), F.max(column).alias("_b")))
    wide = df.where(F.col(column).isNotNull()).crossJoin(ends)
    step = (F.col("_b") - F.col("_a")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("_a"), step), F.lit(0.0)))).cast("int")
    n = F.sum(weight) if weight else F.count("*")
    out = wide.groupBy(bin_.alias("bin")).agg(n.cast("double").alias("n"), F.first(step).alias("_s"))
    if density:
        total = F.broadcast(out.agg(F.sum("n").alias("_t")))
        out = out.crossJoin(total).withColumn("n", F.col("n") / F.col("_t") / F.col("_s"))
    return out.select("bin", "n")


def kde(df: DataFrame, column: str, points: int, cut: float = 3.0) -> DataFrame:
    """(x, density): a Gaussian kernel estimate on a grid, bandwidth n^(-1/5) times the sample deviation.

    The grid is the small side: it is broadcast, and each row adds to points sums.
    """
    s = df.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd"), F.min(column).alias("a"), F.max(column).alias("b"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = s.select("n", h.alias("h"), "a", "b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    x = (F.col("a") - cut * F.col("h")) + F.col("k") * ((F.col("b") - F.col("a")) + 2 * cut * F.col("h")) / (points - 1)
    grid = F.broadcast(grid.select("k", "n", "h", x.alias("x")))
    z = (F.col("x") - F.col(column)) / F.col("h")
    near = df.where(F.col(column).isNotNull()).select(column).join(grid, F.lit(True))
    total = near.groupBy("k", "x", "n", "h").agg(F.sum(F.exp(-z * z / 2)).alias("s"))
    return total.select("k", "x", (F.col("s") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


def box(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the number of outliers."""
    q = ordered.quantiles(df, column, [0.25, 0.5, 0.75], keys, "_q")
    wide = df.join(q, list(keys))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    ok = F.col(column).between(F.col("_q")[0] - 1.5 * iqr, F.col("_q")[2] + 1.5 * iqr)
    first = lambda i: F.first(F.col("_q")[i])
    return wide.groupBy(*keys).agg(
        first(0).alias("q1"), first(1).alias("median"), first(2).alias("q3"), F.min(F.when(ok, F.col(column))).alias("low"),
        F.max(F.when(ok, F.col(column))).alias("high"), F.count(F.when(~ok, 1)).alias("outliers"),
    )


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def mean_error(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("stderr"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """N, mean, deviation, extremes, median, and the bias-corrected kurtosis and skewness."""
    n, g1, g2 = F.count(column).cast("double"), F.skewness(column), F.kurtosis(column)
    rest = df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"), (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
    )
    mid = ordered.quantiles(df, column, [0.5], name="_q").select(F.col("_q")[0].alias("median"))
    return rest.join(F.broadcast(mid), F.lit(True), "left")


def binned_sum(df: DataFrame, column: str, value: str, width: float) -> DataFrame:
    """(mid, total): sums over fixed steps, named by their middles."""
    k = F.floor(F.col(column) / width)
    return df.groupBy(k.alias("k")).agg(F.sum(value).alias("total")).select(((F.col("k") + 0.5) * width).alias("mid"), "total")


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, from one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("x")).select("x.*")
