"""Edge tables: canonical edges, spanning trees, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..errors import ArgumentValueError
from . import ordered


def undirected(df: DataFrame, u: str, v: str, order: str) -> DataFrame:
    """One row for each unordered pair, the last by an order; its other columns are kept."""
    rest = [c for c in df.columns if c not in (u, v)]
    pair = df.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), *rest)
    last = pair.groupBy("a", "b").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select("a", "b", "r.*")


def _written(df: DataFrame) -> DataFrame:
    return scratch.written(df, "graph")


def spanning_tree(edges: DataFrame, u: str = "i", v: str = "j", weight: str = "weight") -> DataFrame:
    """A maximum spanning forest (u, v, weight) by Boruvka rounds; ties go to the least pair.

    Each round every component takes its best edge out and components that meet become one, so the
    rounds grow with the logarithm of the nodes. Nothing but a count reaches the driver; each round is
    written in the shared folder.
    """
    e = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.col(weight).cast("double").alias("w")).where("u <> v")
    e = _written(e.groupBy("u", "v").agg(F.max("w").alias("w")))
    label = _written(e.select(F.col("u").alias("n")).union(e.select("v")).distinct().withColumn("c", F.col("n")))
    tree = None
    while True:
        lu, lv = (label.select(F.col("n").alias(x), F.col("c").alias(f"c{x}")) for x in "uv")
        cross = e.join(lu, "u").join(lv, "v").where("cu <> cv")
        out = cross.select(F.col("cu").alias("c"), F.col("cv").alias("d"), "u", "v", "w").union(cross.select("cv", "cu", "u", "v", "w"))
        # the largest weight, then the least pair
        best = out.groupBy("c").agg(F.min(F.struct((-F.col("w")).alias("nw"), "u", "v", "d")).alias("b")).select("c", "b.d", "b.u", "b.v", (-F.col("b.nw")).alias("w"))
        best = _written(best)
        if not best.limit(1).count():
            break
        picked = best.select("u", "v", "w").distinct()
        tree = picked if tree is None else tree.union(picked)
        # two components that chose one edge: the lesser is the root; the others point along their edge
        back = best.select(F.col("c").alias("bc"), F.col("d").alias("bd"))
        up = best.join(back, (F.col("d") == F.col("bc")) & (F.col("c") == F.col("bd")), "left")
        up = _written(up.select("c", F.when(F.col("bc").isNotNull() & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("p")))
        while True:  # pointer jumping
            far = up.select(F.col("c").alias("x"), F.col("p").alias("q"))
            new = _written(up.join(far, F.col("p") == F.col("x"), "left").select("c", F.coalesce("q", "p").alias("p")))
            moved = new.join(up.withColumnRenamed("p", "o"), "c").where("p <> o").limit(1).count()
            up = new
            if not moved:
                break
        label = _written(label.join(up, "c", "left").select("n", F.coalesce("p", "c").alias("c")))
    if tree is None:
        return e
    return tree.select(F.col("u").alias(u), F.col("v").alias(v), F.col("w").alias(weight))


def spanning_trees(edges: DataFrame, by: str, u: str = "i", v: str = "j", weight: str = "weight") -> DataFrame:
    """(by, u, v, weight): the maximum spanning forest of each group's edges, all groups in the same rounds."""
    kind = dict(edges.dtypes)
    node = lambda c: F.struct(F.col(by).alias("g"), F.col(c).alias("n"))
    tree = spanning_tree(edges.where(F.col(by).isNotNull()).select(node(u).alias("a"), node(v).alias("b"), F.col(weight).alias("w")), "a", "b", "w")
    return tree.select(F.col("a.g").cast(kind[by]).alias(by), F.col("a.n").alias(u), F.col("b.n").alias(v), F.col("w").alias(weight))


def tree_with_extras(edges: DataFrame, n_extra: int = 0, threshold: float | None = None, u: str = "i", v: str = "j", weight: str = "weight") -> DataFrame:
    """The spanning tree and either the n best other edges or those from a threshold on."""
    tree = _written(spanning_tree(edges, u, v, weight))
    rest = edges.select(F.least(u, v).alias(u), F.greatest(u, v).alias(v), F.col(weight)).where(F.col(u) != F.col(v)).join(tree, [u, v], "left_anti")
    more = rest.where(F.col(weight) >= threshold) if threshold is not None else rest.orderBy(F.col(weight).desc(), u, v).limit(n_extra)
    return tree.union(more.select(tree.columns))


def by_interval(df: DataFrame, value: str, intervals: DataFrame) -> DataFrame:
    """The row of a small table (left, right, ...) whose [left, right) holds the value."""
    return df.join(ordered.small(intervals), (F.col(value) >= F.col("left")) & (F.col(value) < F.col("right")), "left")


def with_attributes(nodes: DataFrame, attributes: DataFrame, key: str, must_have: str | None = None) -> DataFrame:
    """Nodes with their attributes; must_have runs one small job and raises if a node lacks it."""
    out = nodes.join(attributes, key, "left")
    if must_have and out.where(F.col(must_have).isNull()).limit(1).count():
        raise ArgumentValueError(f"some nodes have no {must_have}")
    return out


def split_evenly(df: DataFrame, key: str, parts: int, seed: int = 0) -> DataFrame:
    """Deal keys at random into parts whose sizes differ by one at most, the first ones being the larger."""
    rows = ordered.ranked(df.select(key, F.xxhash64(F.lit(seed), key).alias("_h")), "_h", "first", name="_p", tie=key)
    rows = rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    q, r, p = F.floor(F.col("_n") / parts), F.col("_n") % parts, F.col("_p") - 1
    return rows.select(key, (1 + F.when(p < r * (q + 1), F.floor(p / (q + 1))).otherwise(r + F.floor((p - r * (q + 1)) / F.greatest(q, F.lit(1))))).cast("int").alias("part"))


def is_symmetric(edges: DataFrame, u: str = "i", v: str = "j", weight: str = "weight", rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(ok): whether each entry of a long matrix has its like across the diagonal, within tolerances."""
    turned = edges.select(F.col(v).alias(u), F.col(u).alias(v), F.col(weight).alias("_w"))
    near = F.abs(F.col(weight) - F.col("_w")) <= atol + rtol * F.abs(F.col("_w"))
    odd = edges.select(u, v, weight).join(turned, [u, v], "full").where(~F.coalesce(near, F.lit(False)))
    return odd.agg((F.count("*") == 0).alias("ok"))


def _ends(edges: DataFrame, member: DataFrame) -> DataFrame:
    a, b = (member.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ij")
    return edges.join(a, "i").join(b, "j")


def strength_within(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Mean weight of the edges inside each community."""
    return _ends(edges, member).where("ci = cj").groupBy(F.col("ci").alias("community")).agg(F.avg("weight").alias("strength"))


def strength_from(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Mean weight of the edges that leave each community, in the stored orientation."""
    return _ends(edges, member).where("ci <> cj").groupBy(F.col("ci").alias("community")).agg(F.avg("weight").alias("strength"))


def summary(strengths: DataFrame) -> DataFrame:
    s = F.col("strength")
    return strengths.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.max(s).alias("max"), F.min(s).alias("min"))
