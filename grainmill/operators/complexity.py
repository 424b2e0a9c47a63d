"""Economic complexity on long tables (origin, product, value): no matrix is ever wide or collected,
but for the product-by-product similarity of the index, which is as small as the list of products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentValueError
from . import ordered

#: The driver solves a dense eigenproblem of this many products at most (200 MB).
MOST_PRODUCTS = 5000


def advantage(cells: DataFrame, origin: str = "origin", product: str = "product", value: str = "value", name: str = "rca") -> DataFrame:
    """Revealed comparative advantage x X / (x_c x_p); 0 where a total is 0.

    Totals are aggregates joined back; the origin and product totals have one row a key.
    """
    by_origin = cells.groupBy(origin).agg(F.sum(value).alias("_c"))
    by_product = cells.groupBy(product).agg(F.sum(value).alias("_p"))
    total = F.broadcast(cells.agg(F.sum(value).alias("_t")))
    wide = cells.join(by_origin, origin).join(by_product, product).crossJoin(total)
    rca = F.try_divide(F.col(value) * F.col("_t"), F.col("_c") * F.col("_p"))
    return wide.withColumn(name, F.coalesce(rca, F.lit(0.0))).drop("_c", "_p", "_t")


def masked(x: Column, threshold: float = 1.0) -> Column:
    """1.0 from the threshold on, else 0.0; NaN stays."""
    return F.when(F.isnan(x), x).when(x >= threshold, F.lit(1.0)).otherwise(F.lit(0.0))


def proximity(present: DataFrame, origin: str = "origin", product: str = "product", symmetric: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, weight) for products that some origin has both of: joint origins over the larger ubiquity.

    present has one row for each origin and product it has. Asymmetric: over the ubiquity of j. The
    self-join meets on the origin, so its size is the sum of squared baskets, not of all pairs.
    """
    keys = list(by)
    a = present.select(*keys, F.col(origin).alias("_o"), F.col(product).alias("i"))
    b = present.select(*keys, F.col(origin).alias("_o"), F.col(product).alias("j"))
    joint = a.join(b, [*keys, "_o"]).where("i <> j").groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    k = present.groupBy(*keys, product).agg(F.count("*").alias("k"))
    ki, kj = (k.select(*keys, F.col(product).alias(x), F.col("k").alias(f"k_{x}")) for x in "ij")
    joint = joint.join(ki, [*keys, "i"]).join(kj, [*keys, "j"])
    under = F.greatest("k_i", "k_j") if symmetric else F.col("k_j")
    return joint.select(*keys, "i", "j", (F.col("n") / under).alias("weight"))


def edges(near: DataFrame, symmetric: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """An edge list of positive weights: i <= j once when symmetric."""
    keep = near.where("weight > 0")
    return (keep.where("i <= j") if symmetric else keep).select(*by, "i", "j", "weight").distinct()


def relatedness(rca: DataFrame, near: DataFrame, origin: str = "origin", product: str = "product", value: str = "rca") -> DataFrame:
    """(origin, product, relatedness): the advantage of near products, weighted by proximity."""
    total = near.groupBy(F.col("i").alias(product)).agg(F.sum("weight").alias("_w"))
    got = rca.join(near, F.col(product) == F.col("j")).groupBy(origin, F.col("i").alias(product)).agg(F.sum(F.col(value) * F.col("weight")).alias("_s"))
    return got.join(total, product).select(origin, product, F.try_divide("_s", "_w").alias("relatedness"))


def complexity(present: DataFrame, origin: str = "origin", product: str = "product", standardize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(origin, eci) and (product, pci) by the second eigenvector, largest first.

    The similarity of products is summed up by a distributed self-join; the driver gets one number a
    pair of products and solves a symmetric eigenproblem, so it is bounded by the classification.
    """
    spark = present.sparkSession
    pairs = present.select(origin, product).distinct()
    d = pairs.groupBy(origin).agg(F.count("*").alias("d"))
    a, b = (pairs.select(origin, F.col(product).alias(x)) for x in "ij")
    joint = a.join(b, origin).join(d, origin).groupBy("i", "j").agg(F.sum(1 / F.col("d")).alias("s"))
    n = pairs.select(product).distinct().count()
    if n > MOST_PRODUCTS:
        raise ArgumentValueError(f"{n} products; the driver solves for {MOST_PRODUCTS} at most")
    rows = joint.toPandas()
    names = sorted(set(rows["i"]))
    if len(names) < 2:
        raise ArgumentValueError("complexity needs two products or more")
    at = {p: k for k, p in enumerate(names)}
    s = np.zeros((len(names), len(names)))
    s[[at[x] for x in rows["i"]], [at[x] for x in rows["j"]]] = rows["s"]
    u = np.array([r["count"] for r in sorted(pairs.groupBy(product).count().collect(), key=lambda r: r[product])], float)
    _, vectors = np.linalg.eigh(s / np.sqrt(np.outer(u, u)))
    kp = vectors[:, -2] / np.sqrt(u)
    kp /= np.linalg.norm(kp)
    scores = spark.createDataFrame([(p, float(x)) for p, x in zip(names, kp, strict=True)], f"{product} {dict(present.dtypes)[product]}, _k double")
    kc = pairs.join(F.broadcast(scores), product).groupBy(origin).agg(F.avg("_k").alias("_k"), F.count("*").alias("_d"))
    r = kc.agg(F.corr("_d", "_k")).first()[0]
    flip = -1.0 if r is not None and r < 0 else 1.0
    out = []
    for frame, key, name in ((kc, origin, "eci"), (scores, product, "pci")):
        x = frame.select(key, (F.col("_k") * flip).alias(name))
        if standardize:
            m = F.broadcast(x.agg(F.avg(name).alias("_m"), F.stddev_pop(name).alias("_s")))
            x = x.crossJoin(m).select(key, F.try_divide(F.col(name) - F.col("_m"), F.col("_s")).alias(name))
        out.append(x)
    return out[0], out[1]


def at_least(df: DataFrame, keys: list[str], value: str, n: float = 5) -> DataFrame:
    """1.0 for groups whose sum reaches n, else 0.0."""
    return df.groupBy(*keys).agg(F.when(F.sum(value) >= n, 1.0).otherwise(0.0).alias("mask"))


def basket(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, extremes, median and range of a basket's scores."""
    v = F.col(value)
    mid = ordered.quantiles(df, value, [0.5], keys, "_q").select(*keys, F.col("_q")[0].alias("median"))
    rest = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"))
    return rest.join(mid, list(keys)) if keys else rest.join(F.broadcast(mid), F.lit(True), "left")


def nearest_to_quantiles(df: DataFrame, key: str, value: str, quantiles: list[float]) -> DataFrame:
    """For each quantile the row nearest to it; ties by key."""
    q = ordered.quantiles(df, value, quantiles, name="_q")
    at = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("quantile"), F.col("_q")[i].alias("edge")) for i, x in enumerate(quantiles))))
    edges_ = F.broadcast(q.select(at.alias("e")).select("e.*"))
    near = df.crossJoin(edges_).groupBy("quantile").agg(F.min(F.struct(F.abs(F.col(value) - F.col("edge")).alias("gap"), F.col(key).alias(key), F.col(value).alias(value))).alias("b"))
    return near.select("quantile", f"b.{key}", f"b.{value}")
