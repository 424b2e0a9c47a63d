"""Queries of distributions, clusters, regressions and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, distributions, graph, prep, regress, series
from .base import NEAR, PANEL, near, panel, query, rounded

#: Two instruments w and v for x, and what the projections on them need.
_IV = """m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * n AS sxx, covar_pop(x, y) * n AS sxy, var_pop(y) * n AS syy, var_pop(w) * n AS sww, var_pop(v) * n AS svv,
  covar_pop(w, v) * n AS swv, covar_pop(w, x) * n AS swx, covar_pop(v, x) * n AS svx, covar_pop(w, y) * n AS swy, covar_pop(v, y) * n AS svy FROM (SELECT l_extendedprice AS y, l_quantity AS x,
  l_quantity + 100 * l_discount + l_tax * l_linenumber AS w, l_quantity * l_tax AS v FROM lineitem)),
  p AS (SELECT *, sww * svv - swv * swv AS det, (svv * swx - swv * svx) / det AS aw, (sww * svx - swv * swx) / det AS av, aw * swx + av * svx AS pxx, aw * swy + av * svy AS pxy,
  (svv * swy * swy - 2 * swv * swy * svy + sww * svy * svy) / det AS pyy FROM m)"""
_IV_ROWS = """f AS (SELECT *, (1 - k) * sxx + k * pxx AS a, ((1 - k) * sxy + k * pxy) / a AS b, (syy - 2 * b * sxy + b * b * sxx) / (n - 2) AS s2 FROM k),
  r AS (SELECT 'const' AS term, my - b * mx AS coef, sqrt(s2 * (1.0 / n + mx * mx / a)) AS se, n FROM f UNION ALL SELECT 'x', b, sqrt(s2 / a), n FROM f)
  SELECT term, round(coef, 3) AS coef, round(se, 3) AS se, round(coef / se, 3) AS t, n FROM r"""


def _iv(t):
    x, tax = F.col("l_quantity"), F.col("l_tax")
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), x.alias("x"), (x + 100 * F.col("l_discount") + tax * F.col("l_linenumber")).alias("w"), (x * tax).alias("v"))


_YX = "(SELECT l_extendedprice AS y, l_quantity AS x, l_discount AS z FROM lineitem)"


def _yx(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"))


@query("histogram", "SELECT least(19, floor((value - a) / ((b - a) / 20)))::INT AS bin, count(*)::DOUBLE AS n FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) WHERE value IS NOT NULL GROUP BY bin")
def _(t):
    return distributions.histogram(t.events, "value", 20)


@query("histogram_density", "SELECT bin, round(n / sum(n) OVER () / s, 9) AS n FROM (SELECT least(9, floor((value - a) / ((b - a) / 10)))::INT AS bin, count(*) AS n, any_value((b - a) / 10) AS s FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) WHERE value IS NOT NULL GROUP BY bin)")
def _(t):
    return rounded(distributions.histogram(t.events, "value", 10, density=True), "n", digits=9)


@query("kde", "WITH s AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h, min(value) AS a, max(value) AS b FROM events), g AS (SELECT k, n, h, (a - 3 * h) + k * ((b - a) + 6 * h) / 24 AS x FROM s, range(25) AS r(k)) SELECT k::INT AS k, round(x, 6) AS x, round(sum(exp(-pow((x - value) / h, 2) / 2)) / any_value(n * h) / sqrt(2 * pi()), 9) AS density FROM events, g WHERE value IS NOT NULL GROUP BY k, x")
def _(t):
    d = distributions.kde(t.events, "value", 25)
    return rounded(rounded(d, "x"), "density", digits=9)


@query("box_stats", "WITH q AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events GROUP BY event_type), w AS (SELECT e.event_type, value, q, value BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS ok FROM events e JOIN q USING (event_type)) SELECT event_type, round(any_value(q[1]), 6) AS q1, round(any_value(q[2]), 6) AS median, round(any_value(q[3]), 6) AS q3, min(value) FILTER (ok) AS low, max(value) FILTER (ok) AS high, count(*) FILTER (NOT ok) AS outliers FROM w GROUP BY event_type")
def _(t):
    return rounded(distributions.box(t.events, ["event_type"], "value"), "q1", "median", "q3")


@query("mean_stderr", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS stderr FROM events GROUP BY event_type")
def _(t):
    return rounded(distributions.mean_error(t.events, ["event_type"], "value"), "mean", "stderr")


@query("describe_table", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(median(value), 6) AS median, max(value) AS max, round(kurtosis(value), 4) AS kurtosis, round(skewness(value), 4) AS skewness FROM events")
def _(t):
    return rounded(rounded(distributions.describe(t.events, "value"), "mean", "std", "median"), "kurtosis", "skewness", digits=4)


@query("binned_sum", "SELECT (floor(l_quantity / 5) + 0.5) * 5 AS mid, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY mid")
def _(t):
    return rounded(distributions.binned_sum(t.lineitem, "l_quantity", "l_extendedprice", 5.0), "mid", "total", digits=2)


@query("weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY l_returnflag")
def _(t):
    return rounded(distributions.weighted_mean(t.lineitem, ["l_returnflag"], "l_discount", "l_quantity"), "mean", digits=9)


@query("correlation_matrix", f"SELECT a, b, round(CASE a || b WHEN 'xx' THEN 1 WHEN 'yy' THEN 1 WHEN 'zz' THEN 1 WHEN 'xy' THEN xy WHEN 'yx' THEN xy WHEN 'xz' THEN xz WHEN 'zx' THEN xz ELSE yz END, 6)::DOUBLE AS r FROM (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM {_YX}), (SELECT unnest(['x', 'y', 'z']) AS a), (SELECT unnest(['x', 'y', 'z']) AS b)")
def _(t):
    return rounded(distributions.correlations(_yx(t), ["x", "y", "z"]), "r")


@query("r_squared", f"SELECT round(pow(corr(y, x), 2), 9) AS r2 FROM {_YX}")
def _(t):
    return rounded(regress.simple(_yx(t), "y", "x").select("r2"), "r2", digits=9)


@query("confidence_ellipse", "SELECT l_returnflag, round(avg(l_quantity), 6) AS cx, round(avg(l_extendedprice), 4) AS cy, round(corr(l_quantity, l_extendedprice), 6) AS r, round(sqrt(1 + corr(l_quantity, l_extendedprice)), 6) AS rx, round(sqrt(1 - corr(l_quantity, l_extendedprice)), 6) AS ry, round(1.96 * stddev_samp(l_quantity), 6) AS sx, round(1.96 * stddev_samp(l_extendedprice), 4) AS sy FROM lineitem GROUP BY l_returnflag")
def _(t):
    e = clusters.ellipse(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(rounded(e, "cx", "r", "rx", "ry", "sx"), "cy", "sy", digits=4)


# ---- vectors -----------------------------------------------------------------------------------

_CENT = "(SELECT label, i AS pos, avg(embedding[i + 1]::DOUBLE) AS x, median(embedding[i + 1]::DOUBLE) AS m FROM embeddings, unnest(range(0, len(embedding))) AS u(i) GROUP BY label, i)"


@query("centroids_mean", f"SELECT label, pos, round(x, 5) AS x FROM {_CENT}")
def _(t):
    c = clusters.centroids(t.embeddings, "label", "embedding")
    return rounded(c.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x", digits=5)


@query("centroids_median", f"SELECT label, pos, round(m, 5) AS x FROM {_CENT}")
def _(t):
    c = clusters.centroids(t.embeddings, "label", "embedding", "manhattan")
    return rounded(c.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x", digits=5)


@query("dist_to_centroid", f"SELECT vec_id, label, round(sqrt(sum(pow(embedding[pos + 1]::DOUBLE - x, 2))), 5) AS distance FROM embeddings JOIN {_CENT} USING (label) GROUP BY vec_id, label")
def _(t):
    return rounded(clusters.to_own_centroid(t.embeddings, "vec_id", "label", "embedding"), "distance", digits=5)


@query("centroid_distances", f"SELECT a.label AS cluster_i, b.label AS cluster_j, round(sqrt(sum(pow(a.x - b.x, 2))), 5) AS distance FROM {_CENT} a JOIN {_CENT} b USING (pos) GROUP BY ALL")
def _(t):
    return rounded(clusters.between_centroids(t.embeddings, "label", "embedding"), "distance", digits=5)


@query("cluster_size", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _(t):
    return clusters.sizes(t.embeddings, "label")


_COS = "(SELECT q.vec_id AS i, d.vec_id AS j, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 5) AS similarity FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)"


@query("cosine_matrix", f"SELECT * FROM {_COS}")
def _(t):
    return rounded(clusters.similarities(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding"), "similarity", digits=5)


@query("cosine_pairs", f"SELECT * FROM {_COS} WHERE i < j")
def _(t):
    return rounded(clusters.similarities(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding").where("i < j"), "similarity", digits=5)


@query("silhouette", "WITH p AS (SELECT p_brand AS k, min(p_size) % 3 AS c, [avg(p_size), avg(p_retailprice) / 100] AS v FROM part GROUP BY p_brand), d AS (SELECT a.k, a.c AS ca, b.c AS cb, avg(list_distance(a.v, b.v)) AS m FROM p a JOIN p b ON a.k <> b.k GROUP BY ALL), s AS (SELECT k, max(m) FILTER (ca = cb) AS a, min(m) FILTER (ca <> cb) AS b FROM d GROUP BY k) SELECT k, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s")
def _(t):
    p = t.part.groupBy(F.col("p_brand").alias("k")).agg((F.min("p_size") % 3).alias("c"), F.array(F.avg("p_size"), F.avg("p_retailprice") / 100).alias("v"))
    return rounded(clusters.silhouette(p, "k", "c", "v"), "silhouette")


@query("elbow", """WITH p AS (SELECT k, vec_id % k AS c, i, embedding[i]::DOUBLE AS x FROM embeddings, range(2, 9) AS a(k), unnest(range(1, len(embedding) + 1)) AS u(i)),
  s AS (SELECT k, sum(v) AS inertia FROM (SELECT k, c, i, var_pop(x) * count(*) AS v FROM p GROUP BY ALL) GROUP BY k),
  d AS (SELECT *, lead(inertia) OVER (ORDER BY k) - inertia AS step FROM s), r AS (SELECT *, lead(step) OVER (ORDER BY k) / step AS ratio FROM d)
  SELECT k::INT AS k, round(inertia, 4) AS inertia, coalesce(k = (SELECT min(k) FROM r WHERE ratio < (SELECT avg(ratio) FROM r)), false) AS elbow FROM r""")
def _(t):
    tried = t.embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("k")).withColumn("c", F.col("vec_id") % F.col("k"))
    curve = clusters.inertia(tried, ["k", "c"], "embedding").groupBy("k").agg(F.sum("inertia").alias("inertia"))
    return rounded(clusters.elbow(curve).select("k", "inertia", "elbow"), "inertia", digits=4)


@query("kmeans")
def _(t):
    _, rows = clusters.kmeans(t.embeddings, "embedding", 8)
    return rows.select("vec_id", "cluster")


@query("ncluster_search")
def _(t):
    return rounded(rounded(clusters.search_k(t.embeddings, "vec_id", "embedding", 6, n_init=3), "inertia", digits=3), "score")


@query("agglomerative")
def _(t):
    p = t.part.groupBy("p_type", F.col("p_brand").alias("k")).agg(F.array(F.avg("p_size"), F.avg("p_retailprice") / 100).alias("v"))
    return clusters.agglomerate(p, ["p_type"], "k", "v", 4)


# ---- regressions and tests ---------------------------------------------------------------------


@query("ols_simple", f"SELECT round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM {_YX}")
def _(t):
    return rounded(rounded(rounded(regress.simple(_yx(t), "y", "x"), "slope", digits=5), "intercept", digits=4), "r2")


@query("ols_multi", f"""WITH m AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * n AS sxx, var_pop(z) * n AS szz, covar_pop(x, z) * n AS sxz,
  covar_pop(x, y) * n AS sxy, covar_pop(z, y) * n AS szy, var_pop(y) * n AS syy FROM {_YX}),
  b AS (SELECT *, sxx * szz - sxz * sxz AS det, (sxy * szz - szy * sxz) / det AS bx, (szy * sxx - sxy * sxz) / det AS bz, syy - bx * sxy - bz * szy AS rss, rss / (n - 3) AS s2 FROM m),
  r AS (SELECT 'const' AS term, my - bx * mx - bz * mz AS coef, sqrt(s2 * (1.0 / n + (mx * mx * szz - 2 * mx * mz * sxz + mz * mz * sxx) / det)) AS se, 1 - rss / syy AS r2, n FROM b
  UNION ALL SELECT 'x', bx, sqrt(s2 * szz / det), 1 - rss / syy, n FROM b UNION ALL SELECT 'z', bz, sqrt(s2 * sxx / det), 1 - rss / syy, n FROM b)
  SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 4) AS t, round(r2, 4) AS r2, n FROM r""")
def _(t):
    return rounded(t.spark.createDataFrame(regress.ols(_yx(t), "y", ["x", "z"])), "coef", "se", "t", "r2", digits=4)


@query("panel_within", f"SELECT round(sum(x * y) / sum(x * x), 5) AS slope, count(*) AS n FROM (SELECT total - avg(total) OVER (PARTITION BY entity) AS y, n - avg(n) OVER (PARTITION BY entity) AS x FROM {PANEL})")
def _(t):
    return rounded(regress.within(panel(t), "total", "n", "entity"), "slope", digits=5)


@query("panel_between", f"SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM (SELECT avg(total) AS y, avg(n) AS x FROM {PANEL} GROUP BY entity)")
def _(t):
    return rounded(rounded(rounded(regress.between(panel(t), "total", "n", "entity"), "slope", digits=4), "intercept", digits=2), "r2")


@query("panel_fd", f"SELECT round(sum(dx * dy) / sum(dx * dx), 4) AS slope, count(*) AS n FROM (SELECT total - lag(total) OVER w AS dy, n - lag(n) OVER w AS dx FROM (SELECT entity, time, sum(total) AS total, sum(n) AS n FROM {PANEL} GROUP BY ALL) WINDOW w AS (PARTITION BY entity ORDER BY time)) WHERE dx IS NOT NULL")
def _(t):
    p = panel(t).groupBy("entity", "time").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return rounded(regress.first_difference(p, "total", "n", "entity", "time"), "slope", digits=4)


@query("panel_re", f"""WITH p AS (SELECT entity, sum(total) AS y, sum(n) AS x FROM {PANEL} GROUP BY entity, time), g AS (SELECT entity, count(*) AS t, avg(y) AS my, avg(x) AS mx FROM p GROUP BY entity),
  w AS (SELECT sum(yd * xd) / sum(xd * xd) AS s, sum(yd * yd) - sum(yd * xd) * sum(yd * xd) / sum(xd * xd) AS e2, count(*) AS n FROM (SELECT y - my AS yd, x - mx AS xd FROM p JOIN g USING (entity))),
  u AS (SELECT count(*) AS k, avg(t) AS t, count(*) / sum(1.0 / t) AS th, regr_syy(my, mx) - regr_sxy(my, mx) * regr_sxy(my, mx) / regr_sxx(my, mx) AS u2 FROM g),
  v AS (SELECT t, e2 / (n - k - 1) AS se, greatest(0.0, u2 / (k - 2) - se / th) AS su, 1 - sqrt(se / (se + t * su)) AS theta FROM w, u),
  q AS (SELECT 1 - theta AS o, x - theta * mx AS x, y - theta * my AS y, theta FROM p JOIN g USING (entity), v),
  m AS (SELECT count(*) AS n, any_value(theta) AS theta, sum(o * o) AS oo, sum(o * x) AS ox, sum(x * x) AS xx, sum(o * y) AS oy, sum(x * y) AS xy, sum(y * y) AS yy, oo * xx - ox * ox AS d,
  (oy * xx - xy * ox) / d AS bo, (xy * oo - oy * ox) / d AS bx, yy - bo * oy - bx * xy AS rss, rss / (n - 2) AS s2 FROM q),
  r AS (SELECT 'const' AS term, bo AS coef, sqrt(s2 * xx / d) AS se, * FROM m UNION ALL SELECT 'n', bx, sqrt(s2 * oo / d), * FROM m)
  SELECT term, round(coef, 3) AS coef, round(se, 3) AS se, round(coef / se, 3) AS t, round(1 - rss / yy, 3) AS r2, n, round(theta, 3) AS theta FROM r""")
def _(t):
    return rounded(t.spark.createDataFrame(regress.random_effects(panel(t).groupBy("entity", "time").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), "total", "n", "entity")), "coef", "se", "t", "r2", "theta", digits=3)


@query("iv_simple", f"SELECT round(covar_samp(z, y) / covar_samp(z, x), 3) AS slope FROM (SELECT y, x, x + 100 * z AS z FROM {_YX})")
def _(t):
    return rounded(regress.iv_simple(_yx(t).withColumn("z", F.col("x") + 100 * F.col("z")), "y", "x", "z"), "slope", digits=3)


@query("iv_2sls", f"WITH {_IV}, k AS (SELECT *, 1.0::DOUBLE AS k FROM p), {_IV_ROWS}")
def _(t):
    return rounded(t.spark.createDataFrame(regress.two_stage(_iv(t), "y", [], ["x"], ["w", "v"])), "coef", "se", "t", digits=3)


@query("iv_liml", f"""WITH {_IV}, e AS (SELECT *, syy - pyy AS m11, sxy - pxy AS m12, sxx - pxx AS m22, m11 * m22 - m12 * m12 AS dm, (m22 * syy - 2 * m12 * sxy + m11 * sxx) / dm AS tr, (syy * sxx - sxy * sxy) / dm AS dt FROM p),
  k AS (SELECT *, tr / 2 - sqrt(tr * tr / 4 - dt) AS k FROM e), {_IV_ROWS}""")
def _(t):
    return rounded(t.spark.createDataFrame(regress.liml(_iv(t), "y", [], ["x"], ["w", "v"])), "coef", "se", "t", digits=3)


@query("sur")
def _(t):
    p = panel(t)
    return rounded(t.spark.createDataFrame(regress.sur(p.withColumn("m", F.col("total") / F.col("n")), {"a": ("total", ["n"]), "b": ("m", ["n", "time"])})), "coef", digits=3)


@query("rolling_ols", f"SELECT entity, segment, time, round(CASE WHEN c = 3 THEN sl END, 4) AS slope FROM (SELECT entity, segment, time, count(*) OVER w AS c, regr_slope(total, n) OVER w AS sl FROM {PANEL} WINDOW w AS (PARTITION BY entity, segment ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))")
def _(t):
    return rounded(regress.rolling(panel(t), "total", "n", ["entity", "segment"], ["time"], 3).select("entity", "segment", "time", "slope"), "slope", digits=4)


_RES = f"(SELECT entity, segment, time, total - (SELECT regr_intercept(total, n) FROM {PANEL}) - (SELECT regr_slope(total, n) FROM {PANEL}) * n AS e, n FROM {PANEL})"


@query("durbin_watson", f"SELECT entity, round(sum(d * d) / sum(e * e), 6) AS dw FROM (SELECT *, e - lag(e) OVER (PARTITION BY entity ORDER BY segment, time) AS d FROM {_RES}) GROUP BY entity")
def _(t):
    return rounded(regress.durbin_watson(panel(t), "total", "n", "entity", ["segment", "time"]), "dw")


@query("breusch_pagan_lm", f"SELECT round(count(*) * regr_r2(e * e, n), 4) AS lm FROM {_RES}")
def _(t):
    return rounded(regress.breusch_pagan(panel(t), "total", "n"), "lm", digits=4)


@query("white", f"""WITH e AS (SELECT e * e AS y, n AS x, n * n AS z FROM {_RES}), m AS (SELECT count(*) AS n, var_pop(x) * n AS sxx, var_pop(z) * n AS szz, covar_pop(x, z) * n AS sxz,
  covar_pop(x, y) * n AS sxy, covar_pop(z, y) * n AS szy, var_pop(y) * n AS syy FROM e), l AS (SELECT n * ((sxy * szz - szy * sxz) * sxy + (szy * sxx - sxy * sxz) * szy) / (sxx * szz - sxz * sxz) / syy AS lm FROM m)
  SELECT round(lm, 4) AS lm, round(exp(-lm / 2), 4) AS p FROM l""")
def _(t):
    return rounded(t.spark.createDataFrame(regress.white(panel(t), "total", "n")), "lm", "p", digits=4)


@query("vif_pair", f"SELECT round(1 / (1 - pow(corr(x, z), 2)), 6) AS vif FROM {_YX}")
def _(t):
    return rounded(t.spark.createDataFrame(regress.vif(_yx(t), ["x", "z"])).agg(F.max("vif").alias("vif")), "vif")


@query("vif", f"""WITH c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, 1 + 2 * xy * xz * yz - xy * xy - xz * xz - yz * yz AS d FROM {_YX}),
  r AS (SELECT 'x' AS term, (1 - yz * yz) / d AS vif FROM c UNION ALL SELECT 'y', (1 - xz * xz) / d FROM c UNION ALL SELECT 'z', (1 - xy * xy) / d FROM c)
  SELECT term, round(vif, 6) AS vif, CASE WHEN vif <= 5 THEN 'Accept' ELSE 'Reject' END AS verdict FROM r""")
def _(t):
    return rounded(t.spark.createDataFrame(regress.vif(_yx(t), ["x", "z", "y"])), "vif")


@query("prediction_grid", "SELECT k::INT AS k, round(a + k * (b - a) / 99, 6) AS x, round(2 + 0.5 * (a + k * (b - a) / 99) - 0.01 * pow(a + k * (b - a) / 99, 2), 6) AS y FROM (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), range(100) AS r(k)")
def _(t):
    return rounded(regress.predictions(t.lineitem, {"intercept": 2.0, "x": 0.5, "x2": -0.01}, "l_quantity"), "x", "y")


@query("quantreg", f"""WITH p AS (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY entity, time) AS i, total AS y, n AS x FROM {PANEL}),
  c AS (SELECT a.segment, a.i, b.i AS j, (b.y - a.y) / (b.x - a.x) AS s, a.y - s * a.x AS c FROM p a JOIN p b ON a.segment = b.segment AND a.i < b.i AND a.x <> b.x),
  l AS (SELECT c.segment, s, c, sum((y - c - s * x) * (q - (y - c - s * x < 0)::INT)) AS loss FROM c JOIN p USING (segment), (VALUES (0.5)) AS v(q) GROUP BY ALL),
  b AS (SELECT segment, first(s ORDER BY round(loss, 2), s) AS s, first(c ORDER BY round(loss, 2), s) AS c FROM l GROUP BY ALL)
  SELECT segment, 'const' AS term, round(c, 1) AS coef FROM b UNION ALL SELECT segment, 'n', round(s, 1) FROM b""")
def _(t):
    return rounded(regress.grouped(panel(t), ["segment"], "total", ["n"], lambda X, y: regress.quantile_fit(X, y, 0.5)), "coef", digits=1)


@query("quantreg_grid", f"""WITH p AS (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY entity, time) AS i, total AS y, n AS x FROM {PANEL}),
  c AS (SELECT a.segment, a.i, b.i AS j, (b.y - a.y) / (b.x - a.x) AS s, a.y - s * a.x AS c FROM p a JOIN p b ON a.segment = b.segment AND a.i < b.i AND a.x <> b.x),
  l AS (SELECT c.segment, q, s, c, sum((y - c - s * x) * (q - (y - c - s * x < 0)::INT)) AS loss FROM c JOIN p USING (segment), (VALUES (0.25::DOUBLE), (0.5), (0.75)) AS v(q) GROUP BY ALL),
  b AS (SELECT segment, q, first(s ORDER BY round(loss, 2), s) AS s, first(c ORDER BY round(loss, 2), s) AS c FROM l GROUP BY ALL)
  SELECT segment, q AS quantile, 'const' AS term, round(c, 1) AS coef FROM b UNION ALL SELECT segment, q, 'n', round(s, 1) FROM b""")
def _(t):
    parts = [regress.grouped(panel(t), ["segment"], "total", ["n"], lambda X, y, q=q: regress.quantile_fit(X, y, q)).withColumn("quantile", F.lit(q)) for q in (0.25, 0.5, 0.75)]
    return rounded(parts[0].union(parts[1]).union(parts[2]), "coef", digits=1)


@query("rlm")
def _(t):
    return rounded(regress.grouped(panel(t), ["segment"], "total", ["n"], regress.huber_fit), "coef", digits=2)


@query("anderson")
def _(t):
    return rounded(regress.anderson_darling(panel(t), ["segment"], "total"), "a2", digits=4)


@query("tests_by_group")
def _(t):
    return rounded(regress.anderson_darling(panel(t), ["entity"], "n"), "a2", digits=4)


@query("growth_bins", f"SELECT entity, time, 1 + (s > q[1])::INT + (s > q[2])::INT AS quantile FROM (SELECT entity, time, round(sum(total), 2) AS s FROM {PANEL} GROUP BY ALL) JOIN (SELECT time, quantile_cont(s, [1/3, 2/3]) AS q FROM (SELECT entity, time, round(sum(total), 2) AS s FROM {PANEL} GROUP BY ALL) GROUP BY time) USING (time)")
def _(t):
    s = panel(t).groupBy("entity", "time").agg(F.round(F.sum("total"), 2).alias("s"))
    return prep.quantile_bins(s, "s", 3, ["time"]).select("entity", "time", "quantile")


@query("is_symmetric", f"""WITH n AS {NEAR}, m AS (SELECT 'all' AS part, i, j, weight FROM n UNION ALL SELECT 'upper', i, j, weight FROM n WHERE i < j)
  SELECT p.part, count(m.i) = 0 AS ok FROM (SELECT DISTINCT part FROM m) p LEFT JOIN (SELECT a.part, a.i FROM m a LEFT JOIN m b ON a.part = b.part AND a.i = b.j AND a.j = b.i
  WHERE NOT coalesce(abs(a.weight - b.weight) <= 1e-8 + 1e-5 * abs(b.weight), false)) m USING (part) GROUP BY p.part""")
def _(t):
    a = near(t)
    parts = {"all": a, "upper": a.where("i < j")}
    one, two = (graph.is_symmetric(x).select(F.lit(k).alias("part"), "ok") for k, x in parts.items())
    return one.union(two)


@query("shapiro")
def _(t):
    return rounded(series.shapiro_tests(panel(t), ["segment"], "total"), "w", "p", digits=5)


@query("adf")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(series.adf_tests(daily, ["event_type"], "value", "day"), "statistic", "critical", digits=4)


@query("mstl")
def _(t):
    hourly = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(series.decomposed(hourly, ["event_type"], "value", "day", [7]), "trend", "season_7", "rest", digits=4)


@query("markov_regimes")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(series.regimes(daily, ["event_type"], "value", "day"), "mean", "sd", "stay", digits=3)


@query("markov_autoregression")
def _(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(series.autoregressive_regimes(daily, ["event_type"], "value", "day"), "const", "lag_1", "sd", "stay", digits=3)


@query("iv_gmm_updating")
def _(t):
    return rounded(t.spark.createDataFrame(series.gmm(_iv(t), "y", [], ["x"], ["w", "v"], updating=True)), "coef", "se", "z", "j", digits=2)


@query("factor_premia", f"""WITH p AS (SELECT entity, time, avg(total) AS r FROM {PANEL} GROUP BY entity, time), m AS (SELECT time, avg(r) AS market FROM p GROUP BY time),
  l AS (SELECT entity, avg(r) AS y, regr_slope(r, market) AS x FROM p JOIN m USING (time) GROUP BY entity),
  s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, sxy / sxx AS b, (syy - b * sxy) / (n - 2) AS s2, b * sxy / syy AS r2 FROM l),
  r AS (SELECT 'const' AS term, my - b * mx AS coef, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se, r2, n FROM s UNION ALL SELECT 'beta_market', b, sqrt(s2 / sxx), r2, n FROM s)
  SELECT term, round(coef, 3) AS coef, round(se, 3) AS se, round(coef / se, 3) AS t, round(r2, 3) AS r2, n FROM r""")
def _(t):
    p = panel(t).groupBy("entity", "time").agg(F.avg("total").alias("r"))
    market = p.groupBy("time").agg(F.avg("r").alias("market"))
    _, premia = series.factor_premia(p.join(market, "time"), "entity", "r", ["market"])
    return rounded(t.spark.createDataFrame(premia), "coef", "se", "t", "r2", digits=3)


@query("iv_gmm")
def _(t):
    d = _yx(t).withColumn("w", F.col("x") + 100 * F.col("z"))
    return rounded(t.spark.createDataFrame(series.gmm(d, "y", [], ["x"], ["w", "z"])), "coef", "se", "z", "j", digits=3)
