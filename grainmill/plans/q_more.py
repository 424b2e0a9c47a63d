"""Queries of names, coefficient tables, packed bits, checks and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import bits, geo
from ..operators import checks, coefficients, names, prep, text
from ..sources import files, records
from ..streaming import pending, requests
from .base import PANEL, panel, query, rounded

_LOW = "list_transform(regexp_extract_all(text, '([A-Za-z]{2,}[0-9]{0,1})', 1), lambda x: lower(x))"


@query("coef_table_reshape", """WITH b AS (SELECT p_brand AS v, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part GROUP BY p_brand),
  r AS (SELECT v, q FROM b UNION ALL SELECT 'Brand#11_square', q FROM b WHERE v = 'Brand#11')
  SELECT 'QuantReg' AS type, 'quadratic' AS degree, 'price' AS dependent, CASE WHEN v IN ('Brand#11', 'Brand#11_square') THEN 'Exog' ELSE 'Control' END AS role, v AS variable,
  round(q[1], 6) AS q25, round(q[2], 6) AS q50, round(q[3], 6) AS q75 FROM r""")
def _(t):
    from ..operators import ordered

    found = ordered.quantiles(t.part, "p_retailprice", [0.25, 0.5, 0.75], ["p_brand"], "q")
    wide = found.select(F.format_string("I(%s)", "p_brand").alias("term"), *(F.col("q")[k].alias(q) for k, q in enumerate(("0.25", "0.5", "0.75"))))
    wide = wide.union(wide.where("term = 'I(Brand#11)'").withColumn("term", F.lit("I(Brand#11_square)")))
    table = coefficients.classified(coefficients.long(wide, "term", ["0.25", "0.5", "0.75"]), ["Brand#11"], "QuantReg", "price")
    return rounded(coefficients.by_quantile(table, [0.25, 0.5, 0.75]), "q25", "q50", "q75")


@query("fuzzy_country", """WITH c AS (SELECT lower(n_name) || ' republic' AS c FROM nation)
  SELECT c AS token, c AS country FROM c UNION ALL SELECT left(c, len(c) - 1), c FROM c UNION ALL SELECT left(c, len(c) - 4), NULL FROM c
  UNION ALL SELECT * FROM (VALUES ('sevenths', 'nation_7 republic'), ('uk', 'united kingdom'), ('zzz', NULL))""")
def _(t):
    c = t.nation.select(F.concat(F.lower("n_name"), F.lit(" republic")).alias("token"))
    known = sorted(r.token for r in c.collect()) + ["united kingdom"]  # 25 rows: the list is the parameter
    cut = [c.select(F.expr(f"left(token, length(token) - {k})").alias("token")) for k in (1, 4)]
    more = t.spark.createDataFrame([("sevenths",), ("uk",), ("zzz",)], "token string")
    return names.countries_in(c.union(cut[0]).union(cut[1]).union(more), "token", known, {"sevenths": "nation_7 republic"})


@query("country_names", "SELECT n_name, CASE WHEN regexp_matches(n_name, '(?i)^united k') THEN 'United Kingdom' WHEN regexp_matches(n_name, '(?i)^united') THEN 'United States' WHEN regexp_matches(n_name, '(?i)iran') THEN 'Iran' ELSE 'not found' END AS country FROM nation")
def _(t):
    return names.converted(t.nation, "n_name", [("^united k", "United Kingdom"), ("^united", "United States"), ("iran", "Iran")]).select("n_name", "country")


@query("short_names", """SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = len(w) THEN w[i] ELSE w[i][1:3] END), '') AS name
  FROM (SELECT p_partkey, string_split(replace(p_name, '-', ''), ' ') AS w FROM part)""")
def _(t):
    return t.part.select("p_partkey", names.short(F.col("p_name")).alias("name"))


@query("stop_words", f"SELECT doc_id, len(list_filter({_LOW}, lambda x: x NOT IN ('the', 'of')))::BIGINT AS n FROM documents")
def _(t):
    stop = names.StopWords(t.spark, None)
    stop.add("the", "of", "gone")
    stop.remove("gone")
    return t.documents.select("doc_id", F.size(stop.without(text.tokens(F.col("text")))).cast("long").alias("n"))


@query("bit_array", """SELECT n_nationkey AS k, repeat('00', (n_nationkey // 8)::INT) || printf('%02X', (1 << (n_nationkey % 8))::INT) || repeat('00', (3 - n_nationkey // 8)::INT) AS bits,
  1 AS own, CASE WHEN n_nationkey = 3 THEN 1 ELSE 0 END AS third, 0 AS cleared FROM nation""")
def _(t):
    k = F.col("n_nationkey").cast("int")
    b = t.nation.select(k.alias("k"), bits.put(bits.zeros(32), k, F.lit(True)).alias("b"))
    return b.select("k", F.hex("b").alias("bits"), bits.get(F.col("b"), F.col("k")).alias("own"), bits.get(F.col("b"), F.lit(3)).alias("third"), bits.get(bits.put(F.col("b"), F.col("k"), F.lit(False)), F.col("k")).alias("cleared"))


@query("number_set", "SELECT n_regionkey, count(DISTINCT n_nationkey) AS n FROM nation GROUP BY n_regionkey")
def _(t):
    return bits.number_set(t.nation.union(t.nation), ["n_regionkey"], "n_nationkey").select("n_regionkey", F.bitmap_count("bits").alias("n"))


@query("network_columns", "SELECT n_name AS name, n_regionkey AS g, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::DOUBLE ELSE 1.0 END AS weight FROM nation")
def _(t):
    k = F.col("n_nationkey")
    nodes, edges = names.network_columns(t.nation.select(k.alias("k"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("g")), t.nation.select(k.alias("k"), F.when(k % 2 == 0, k).alias("width")))
    return nodes.join(edges, "k").select("name", "g", "weight")


@query("distinct_frames", "SELECT r_regionkey AS k, count(*) AS n FROM region GROUP BY r_regionkey")
def _(t):
    a, b = t.region.select(F.col("r_regionkey").alias("k")), t.region.select(F.col("r_regionkey").alias("k")).orderBy(F.desc("k"))
    kept = names.distinct_frames([a, b, a.where("k < 0"), b])
    out = kept[0]
    for f in kept[1:]:
        out = out.union(f)
    return out.groupBy("k").agg(F.count("*").alias("n"))


@query("flow_problems", """SELECT DISTINCT '(' || y || ', ' || (y + 1) || ')' || CASE WHEN m = 1 THEN '?' ELSE '' END AS period, (1 + m % 3) || '_2-Gram' || CASE WHEN m = 4 THEN 's' ELSE '' END AS ngram,
  CASE WHEN m = 1 THEN 'period' WHEN m = 4 THEN 'ngram' ELSE 'order' END AS problem FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders) WHERE m = 1 OR m = 4 OR m % 3 = 2""")
def _(t):
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    period = F.concat(F.lit("("), y, F.lit(", "), y + 1, F.lit(")"), F.when(m == 1, "?").otherwise(""))
    gram = F.concat(1 + m % 3, F.lit("_2-Gram"), F.when(m == 4, "s").otherwise(""))
    return checks.flow_problems(t.orders.select(period.alias("period"), gram.alias("ngram")))


@query("geojson_bounds", "SELECT n_name AS name, n_nationkey * 2.0::DOUBLE AS west, n_regionkey * 10.0::DOUBLE AS south, n_nationkey * 2.0::DOUBLE + 1 AS east, n_regionkey * 10.0::DOUBLE + 3 AS north FROM nation")
def _(t):
    at = scratch.path(t.spark, "geojson")
    x, y = F.col("n_nationkey") * 2.0, F.col("n_regionkey") * 10.0
    square = lambda h: F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + h), F.array(x, y + h), F.array(x, y))
    many = F.to_json(F.array(F.array(square(1)), F.array(square(3))))
    feature = F.format_string('{"type": "Feature", "properties": {"name": "%s"}, "geometry": {"type": "MultiPolygon", "coordinates": %s}}', F.col("n_name"), many)
    whole = t.nation.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("t"))
    files.write_texts(whole, "t", at)
    return files.bounds(files.polygons(t.spark, at).select(F.col("properties")["name"].alias("name"), "ring"), ["name"])


@query("points_in_union", "SELECT s_suppkey FROM supplier, (SELECT s_suppkey % 20 AS x, s_suppkey % 13 AS y, s_suppkey AS k FROM supplier) p WHERE k = s_suppkey AND ((x > 1 AND x < 7 AND y > 1 AND y < 5) OR (x > 5 AND x < 12 AND y > 2 AND y < 9))")
def _(t):
    square = lambda w, s, e, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    rings = t.spark.createDataFrame([(square(1.5, 1.5, 6.5, 4.5),), (square(5.5, 2.5, 11.5, 8.5),)], "ring array<array<double>>")
    points = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 20).cast("double").alias("x"), (F.col("s_suppkey") % 13).cast("double").alias("y"))
    return geo.in_any(points, rings, "x", "y").select("s_suppkey")


@query("log_or_plain_model", f"SELECT entity, round(regr_slope(ln(total), n), 9) AS slope FROM {PANEL} GROUP BY entity")
def _(t):
    from ..operators import regress

    p = prep.mapped(panel(t), ["total"], F.ln, "log")
    return rounded(regress.simple(p, names.transformed(p, "total", "log"), names.transformed(p, "n"), ["entity"]).select("entity", "slope"), "slope", digits=9)


@query("request_json", """SELECT n_nationkey, to_json({'includedTypes': ['bar', 'cafe'], 'maxResultCount': 20, 'locationRestriction': {'circle': {'center': {'latitude': n_regionkey + 0.5::DOUBLE, 'longitude': n_nationkey + 0.25::DOUBLE}, 'radius': 150.0::DOUBLE}}, 'languageCode': 'en'})::VARCHAR AS circle,
  to_json({'location': (n_regionkey + 0.5::DOUBLE)::VARCHAR || ', ' || (n_nationkey + 0.25::DOUBLE)::VARCHAR, 'radius': '150', 'type': 'bar', 'key': '', 'language': 'en'})::VARCHAR AS plain FROM nation""")
def _(t):
    x, y = F.col("n_nationkey") + F.lit(0.25), F.col("n_regionkey") + F.lit(0.5)
    return t.nation.select("n_nationkey", requests.nearby_circle(x, y, 150, ["bar", "cafe"]).alias("circle"), requests.nearby(x, y, 150, "bar").alias("plain"))


@query("search_resumed", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 17)")
def _(t):
    at, shops = scratch.path(t.spark, "search"), t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    find = lambda points: points.join(shops, "n_nationkey").select("s_suppkey")
    for budget in (7, 10):  # the second call goes on where the first ended
        found, _ = pending.search(t.spark, t.nation.select("n_nationkey"), "n_nationkey", find, at, budget, 4)
    return found


@query("trees_by_period", """WITH RECURSIVE n AS (SELECT s_nationkey % 3 AS g, least(a, b) AS i, greatest(a, b) AS j, max(w) AS w FROM (SELECT s_nationkey, s_nationkey AS a, s_suppkey % 11 + 30 AS b, s_suppkey % 7 + 1.0::DOUBLE AS w FROM supplier) GROUP BY ALL),
  r AS (SELECT g, i AS u0, j AS v0, w AS w0, i AS node FROM n UNION SELECT r.g, u0, v0, w0, CASE WHEN n.i = r.node THEN n.j ELSE n.i END FROM r JOIN n ON n.g = r.g AND (n.i = r.node OR n.j = r.node)
  AND (n.w > w0 OR (n.w = w0 AND (n.i < u0 OR (n.i = u0 AND n.j < v0)))))
  SELECT g, i, j, w AS weight FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.g = n.g AND u0 = i AND v0 = j AND node = j)""")
def _(t):
    from ..operators import graph

    e = t.supplier.select((F.col("s_nationkey") % 3).alias("g"), F.col("s_nationkey").cast("long").alias("i"), (F.col("s_suppkey") % 11 + 30).cast("long").alias("j"), (F.col("s_suppkey") % 7 + F.lit(1.0)).cast("double").alias("weight"))
    return graph.spanning_trees(e, "g")


def _log(t):
    head = F.format_string("Fixed-effects (within) regression    Number of obs     =      %,d\nR-squared:  within  = 0.%02d\n  sigma_u |  %.2f\n", "p_partkey", "p_size", "p_retailprice")
    table = F.format_string(". vif y x\n    Variable |       VIF       1/VIF\n-------------+-----\n   x%d |    %.2f    0.500000\n   z |   .   1.5*\n", "p_size", "p_retailprice")
    return t.part.select("p_partkey", F.concat(F.lit(". xtreg y x, fe\n"), head, table).alias("log"), F.format_string("/logs/a_fe_%s_%d.log", F.regexp_replace("p_brand", "#", ""), "p_partkey").alias("path"))


@query("log_statistics", """SELECT p_partkey, 'xtreg' AS command, name, value FROM (SELECT p_partkey, 'Number of obs' AS name, p_partkey::DOUBLE AS value FROM part UNION ALL
  SELECT p_partkey, 'within', p_size / 100 FROM part UNION ALL SELECT p_partkey, 'sigma_u', round(p_retailprice, 2)::DOUBLE FROM part)""")
def _(t):
    got = records.parsed(_log(t), "log_statistics", "log", ["p_partkey"])
    return got.select("p_partkey", "command", F.regexp_extract("name", r"(Number of obs|within|sigma_u)$", 1).alias("name"), "value")


@query("log_tables", """SELECT p_partkey, r AS row, h AS "column", v AS value, m AS marked FROM (SELECT p_partkey, 'x' || p_size AS r, 'VIF' AS h, round(p_retailprice, 2)::DOUBLE AS v, false AS m FROM part UNION ALL
  SELECT p_partkey, 'x' || p_size, '1/VIF', 0.5, false FROM part UNION ALL SELECT p_partkey, 'z', 'VIF', NULL, false FROM part UNION ALL SELECT p_partkey, 'z', '1/VIF', 1.5, true FROM part)""")
def _(t):
    return records.parsed(_log(t), "log_tables", "log", ["p_partkey"]).select("p_partkey", "row", "column", "value", "marked")


@query("log_identity", "SELECT p_partkey, 'a' AS tag, 'fe' AS type, replace(p_brand, '#', '') AS \"group\", p_partkey::VARCHAR AS id FROM part")
def _(t):
    return _log(t).select("p_partkey", records.log_identity(F.col("path")).alias("i")).select("p_partkey", "i.*")
