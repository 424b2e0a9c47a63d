"""Queries of economic complexity and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import complexity, graph, reshape
from .base import CELLS, NEAR, PANEL, PRESENT, RCA, cells, near, panel, present, query, rca, rounded


@query("export_matrix", f"SELECT origin, product, round(coalesce(value, 0), 2) AS value FROM (SELECT * FROM (SELECT DISTINCT origin FROM {CELLS}), (SELECT DISTINCT product FROM {CELLS})) LEFT JOIN {CELLS} USING (origin, product)")
def _(t):
    return rounded(reshape.dense_grid(cells(t), "origin", "product", "value"), "value", digits=2)


@query("rca", f"SELECT origin, product, round(rca, 6) AS rca FROM {RCA}")
def _(t):
    return rounded(rca(t), "rca")


@query("rca_mask", f"SELECT origin, product, (rca >= 1)::INT::DOUBLE AS m FROM {RCA}")
def _(t):
    return rca(t).select("origin", "product", complexity.masked(F.col("rca")).alias("m"))


@query("having_mask", f"SELECT product, CASE WHEN sum(rca) >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM {RCA} GROUP BY product")
def _(t):
    return complexity.at_least(rca(t), ["product"], "rca", 5)


@query("proximity", f"SELECT i, j, round(weight, 6) AS weight FROM {NEAR}")
def _(t):
    return rounded(near(t), "weight")


@query("proximity_edges", f"SELECT i, j, round(weight, 6) AS weight FROM {NEAR} WHERE i <= j AND weight > 0")
def _(t):
    return rounded(complexity.edges(near(t)), "weight")


@query("proximity_by_period", """WITH v AS (SELECT year(l_shipdate)::INT AS period, n_regionkey AS origin, p_type AS product, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), p AS (SELECT period, origin, product FROM v QUALIFY value >= avg(value) OVER (PARTITION BY period)),
  k AS (SELECT period, product, count(*) AS k FROM p GROUP BY ALL)
  SELECT a.period, a.product AS i, b.product AS j, round(count(*) / greatest(any_value(x.k), any_value(y.k)), 6) AS weight FROM p a JOIN p b USING (period, origin) JOIN k x ON x.period = a.period AND x.product = a.product
  JOIN k y ON y.period = b.period AND y.product = b.product WHERE a.product < b.product GROUP BY ALL""")
def _(t):
    sold = t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice", F.year("l_shipdate").alias("period"))
    sold = sold.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    v = sold.groupBy("period", F.col("n_regionkey").alias("origin"), F.col("p_type").alias("product")).agg(F.sum("l_extendedprice").alias("value"))
    has = v.join(v.groupBy("period").agg(F.avg("value").alias("m")), "period").where("value >= m").select("period", "origin", "product")
    return rounded(complexity.edges(complexity.proximity(has, by=("period",)), by=("period",)), "weight")


@query("relatedness", f"SELECT origin, n.i AS product, round(sum(rca * weight) / any_value(w), 6) AS relatedness FROM {RCA} r JOIN {NEAR} n ON r.product = n.j JOIN (SELECT i, sum(weight) AS w FROM {NEAR} GROUP BY i) t ON t.i = n.i GROUP BY origin, n.i")
def _(t):
    return rounded(complexity.relatedness(rca(t), near(t)), "relatedness")


@query("eci")
def _(t):
    return rounded(complexity.complexity(present(t))[0], "eci")


@query("pci")
def _(t):
    return rounded(complexity.complexity(present(t))[1], "pci")


@query("basket_stats", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std, min(p_retailprice) AS min, max(p_retailprice) AS max, round(median(p_retailprice), 6) AS median, round(max(p_retailprice) - min(p_retailprice), 6) AS range FROM part GROUP BY p_brand")
def _(t):
    return rounded(complexity.basket(t.part, ["p_brand"], "p_retailprice"), "mean", "std", "median", "range")


@query("closest_to_quantile", "SELECT q AS quantile, p_partkey, p_retailprice FROM part, (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS q, unnest(quantile_cont(p_retailprice, [0.05, 0.5, 0.95])) AS edge FROM part) QUALIFY row_number() OVER (PARTITION BY q ORDER BY abs(p_retailprice - edge), p_partkey) = 1")
def _(t):
    return complexity.nearest_to_quantiles(t.part.select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", [0.05, 0.5, 0.95])


@query("edge_list", "SELECT least(n_nationkey, k) AS a, greatest(n_nationkey, k) AS b, arg_max(w, w) AS w FROM (SELECT n_nationkey, n_regionkey * 5 AS k, n_nationkey * 3 % 7 AS w FROM nation UNION ALL SELECT n_regionkey * 5, n_nationkey, n_nationkey * 5 % 11 FROM nation) GROUP BY ALL")
def _(t):
    n = t.nation
    two = n.select(F.col("n_nationkey").alias("u"), (F.col("n_regionkey") * 5).alias("v"), (F.col("n_nationkey") * 3 % 7).alias("w"))
    two = two.union(n.select(F.col("n_regionkey") * 5, F.col("n_nationkey"), F.col("n_nationkey") * 5 % 11))
    return graph.undirected(two, "u", "v", "w")


@query("max_spanning_tree", f"""WITH RECURSIVE n AS {NEAR}, e AS (SELECT DISTINCT least(i, j) AS u, greatest(i, j) AS v, weight AS w FROM n WHERE weight > 0),
  r AS (SELECT u AS u0, v AS v0, w AS w0, u AS node FROM e UNION
  SELECT u0, v0, w0, CASE WHEN e.u = r.node THEN e.v ELSE e.u END FROM r JOIN e ON (e.u = r.node OR e.v = r.node) AND (e.w > w0 OR (e.w = w0 AND (e.u < u0 OR (e.u = u0 AND e.v < v0)))))
  SELECT u AS i, v AS j, round(w, 6) AS weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE u0 = u AND v0 = v AND node = v)""")
def _(t):
    return rounded(graph.spanning_tree(complexity.edges(near(t))), "weight")


@query("interval_bin_join", f"SELECT i, j, width::INT AS width FROM {NEAR} JOIN (VALUES (0.0, 0.3, 1), (0.3, 0.5, 2), (0.5, 2.0, 3)) AS b(l, r, width) ON weight >= l AND weight < r")
def _(t):
    bins = t.spark.createDataFrame([(0.0, 0.3, 1), (0.3, 0.5, 2), (0.5, 2.0, 3)], "left double, right double, width int")
    return graph.by_interval(near(t), "weight", bins).select("i", "j", "width")


@query("node_attr_join", f"SELECT product, p_n FROM (SELECT DISTINCT i AS product FROM {NEAR}) JOIN (SELECT p_brand AS product, count(*) AS p_n FROM part GROUP BY p_brand) USING (product)")
def _(t):
    nodes = near(t).select(F.col("i").alias("product")).distinct()
    return graph.with_attributes(nodes, t.part.groupBy(F.col("p_brand").alias("product")).agg(F.count("*").alias("p_n")), "product", "p_n")


_MEMBER = "(SELECT DISTINCT p_brand AS node, length(p_brand) + right(p_brand, 1)::INT % 3 AS community FROM part)"


def _members(t):
    return t.part.select(F.col("p_brand").alias("node"), (F.length("p_brand") + F.expr("CAST(right(p_brand, 1) AS INT)") % 3).cast("long").alias("community")).distinct()


@query("community_within", f"SELECT a.community::BIGINT AS community, round(avg(weight), 6) AS strength FROM {NEAR} n JOIN {_MEMBER} a ON a.node = i JOIN {_MEMBER} b ON b.node = j WHERE i <= j AND a.community = b.community GROUP BY a.community")
def _(t):
    return rounded(graph.strength_within(complexity.edges(near(t)), _members(t)), "strength")


@query("community_from", f"SELECT a.community::BIGINT AS community, round(avg(weight), 6) AS strength FROM {NEAR} n JOIN {_MEMBER} a ON a.node = i JOIN {_MEMBER} b ON b.node = j WHERE i <= j AND a.community <> b.community GROUP BY a.community")
def _(t):
    return rounded(graph.strength_from(complexity.edges(near(t)), _members(t)), "strength")


@query("community_summary", f"SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(max(s), 6) AS max, round(min(s), 6) AS min FROM (SELECT avg(weight) AS s FROM {NEAR} n JOIN {_MEMBER} a ON a.node = i JOIN {_MEMBER} b ON b.node = j WHERE i <= j AND a.community = b.community GROUP BY a.community)")
def _(t):
    return rounded(graph.summary(graph.strength_within(complexity.edges(near(t)), _members(t))), "mean", "std", "max", "min")


@query("split_sizes", "SELECT (k + 1)::INT AS part, (count(*) // 4 + (k < count(*) % 4)::INT)::BIGINT AS n FROM nation, range(4) AS r(k) GROUP BY k")
def _(t):
    return graph.split_evenly(t.nation, "n_nationkey", 4).groupBy("part").agg(F.count("*").alias("n"))


@query("degree_steps", f"SELECT segment, time, round(0.00375 * r / first_value(r) OVER (PARTITION BY segment ORDER BY time), 9) AS step FROM (SELECT segment, time, sum(n) AS r FROM {PANEL} GROUP BY ALL)")
def _(t):
    from pyspark.sql import Window

    r = panel(t).groupBy("segment", "time").agg(F.sum("n").alias("r"))
    first = F.first("r").over(Window.partitionBy("segment").orderBy("time"))
    return r.select("segment", "time", F.round(F.lit(0.00375) * F.col("r") / first, 9).alias("step"))


@query("radial_subsample", """WITH c AS (SELECT n_nationkey * 2.0 AS lon, n_regionkey * 10.0 AS lat FROM nation)
  SELECT lon::DOUBLE AS lon, lat::DOUBLE AS lat, round(lon + 100.0 * r * cos(2 * pi() * k / 6) / (111132.95 * cos(radians(lat))), 9) AS x, round(lat + 100.0 * r * sin(2 * pi() * k / 6) / 111132.95, 9) AS y FROM c, range(1, 4) AS a(r), range(6) AS b(k)
  UNION ALL SELECT lon, lat, lon, lat FROM c""")
def _(t):
    c = t.nation.select((F.col("n_nationkey") * 2.0).alias("lon"), (F.col("n_regionkey") * 10.0).alias("lat"))
    return rounded(geo.subsampled(c, 300.0, 100.0, 6), "x", "y", digits=9)


@query("grid_sample", """WITH e AS (SELECT * FROM (VALUES (0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.2, 0.8), (1.2, 0.8, 0.3, 1.0), (0.3, 1.0, 0.0, 0.0)) AS t(a, b, c, d)),
  g AS (SELECT i * 0.05::DOUBLE AS x, j * 0.05::DOUBLE AS y FROM range(24) AS p(i), range(20) AS q(j)),
  c AS (SELECT x, y, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, greatest(0.0, least(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) * (c - a) + (d - b) * (d - b)))) AS t FROM g, e),
  f AS (SELECT x, y, sum(((b > y) <> (d > y) AND x < (c - a) * (y - b) / nullif(d - b, 0) + a)::INT) AS n, min(sqrt(pow(x - a - t * (c - a), 2) + pow(y - b - t * (d - b), 2))) AS far FROM c GROUP BY x, y)
  SELECT round(x, 6) AS lon, round(y, 6) AS lat FROM f WHERE n % 2 = 1 AND far >= greatest(2000 / 111132.95, 2000 / (111132.95 * cos(radians(y))))""")
def _(t):
    return rounded(geo.circle_grid(t.spark, [(0.0, 0.0), (1.0, 0.0), (1.2, 0.8), (0.3, 1.0)], 2000.0, 0.05, "within"), "lon", "lat")


@query("saturation_refine", """WITH RECURSIVE s AS (SELECT n_nationkey AS n, 1 AS r FROM nation WHERE n_nationkey < 4 UNION
  SELECT s.n * 2 + k, r + 1 FROM s, range(2, 4) AS u(k) WHERE r < 3 AND (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_nationkey = s.n) >= 3)
  SELECT DISTINCT s_suppkey FROM supplier JOIN s ON s_nationkey = s.n""")
def _(t):
    from ..streaming import pending

    shops = t.supplier.select("s_suppkey", "s_nationkey")
    find = lambda at: at.join(shops, "s_nationkey").select("s_nationkey", "s_suppkey")
    narrow = lambda full: full.select(F.explode(F.array(F.col("s_nationkey") * 2 + 2, F.col("s_nationkey") * 2 + 3)).alias("s_nationkey")).distinct()
    return pending.refine(t.nation.where("n_nationkey < 4").select(F.col("n_nationkey").alias("s_nationkey")), find, narrow, ["s_nationkey"], "s_suppkey", 3, 3)
