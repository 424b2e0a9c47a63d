"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python_udfs, scalars
from ..operators import select
from .base import query, rounded



@query("strip_punctuation", f"SELECT conv_id, turn, trim(lower(trim(text, ' ')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~') AS ends, regexp_replace(lower(trim(text, ' ')), '[[:punct:]]', '', 'g') AS everywhere FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", scalars.strip_punctuation(F.col("text")).alias("ends"), scalars.strip_punctuation(F.col("text"), True).alias("everywhere"))


@query("array_chunks", "SELECT p_partkey, i AS pos, ws[3 * i + 1:3 * i + 3] AS chunk FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS ws FROM part), unnest(range(0, (len(ws) + 2) // 3)) AS u(i)")
def _(t):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    return t.part.select("p_partkey", F.posexplode(scalars.chunks(words, 3)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("is_number", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS ok FROM events")
def _(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.col("event_type")).when(k == 2, F.concat(F.lit(" "), F.col("user_id").cast("string"))).otherwise("")
    return t.events.select("event_id", scalars.is_number(text).alias("ok"))


@query("extract_numbers", r"SELECT event_id, list_transform(regexp_extract_all(props || ' ' || value::VARCHAR, '(\d*\.?\d+|\d+\.?\d*|\.)', 1), lambda x: coalesce(TRY_CAST(x AS DOUBLE), 0)) AS numbers FROM events WHERE value IS NOT NULL")
def _(t):
    text = F.concat_ws(" ", "props", F.col("value").cast("string"))
    return t.events.where("value IS NOT NULL").select("event_id", scalars.numbers_in(text).alias("numbers"))


@query("squeeze_spaces", r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(scalars.squeeze(F.col("text")).cast("binary")).alias("h"))


@query("remove_chars", "SELECT p_partkey, replace(replace(p_name, 'a', ''), 'e', '') AS name FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.without_chars(F.col("p_name"), "ae").alias("name"))


@query("replace_prefix", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'One-' || substr(p_brand, 8) ELSE p_brand END AS brand FROM part")
def _(t):
    return t.part.select("p_partkey", scalars.swap_prefix(F.col("p_brand"), "Brand#1", "One-").alias("brand"))


@query("split_camel", r"SELECT n_nationkey, list_filter(string_split(regexp_replace(initcap, '([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS parts FROM (SELECT n_nationkey, 'x' || upper(n_name[1]) || lower(n_name[2:]) || 'Of' || 'Region' AS initcap FROM nation)")
def _(t):
    name = F.concat(F.lit("x"), F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")), F.lit("OfRegion"))
    return t.nation.select("n_nationkey", scalars.split_camel(F.array(name)).alias("parts"))


@query("add_significance", "SELECT event_id, user_id::VARCHAR || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS text FROM (SELECT *, (event_id % 1000) / 10000.0 AS p FROM events)")
def _(t):
    p = (F.col("event_id") % 1000) / F.lit(10000.0)
    return t.events.select("event_id", scalars.starred(F.concat(F.col("user_id").cast("string"), F.lit(" ("), p.cast("string"), F.lit(")"))).alias("text"))


@query("coef_significance_parse", "SELECT event_id, round(user_id / 4.0, 3)::DOUBLE AS value, event_id % 4 AS stars FROM events")
def _(t):
    text = F.concat(F.format_string("%.3f", F.col("user_id") / F.lit(4.0)), F.expr("repeat('*', CAST(event_id % 4 AS INT))"))
    value, stars = scalars.parse_starred(text)
    return t.events.select("event_id", value.alias("value"), stars.cast("long").alias("stars"))


@query("md5_id", "SELECT o_orderkey, substr(md5(o_orderstatus), 1, 6) || '-' || substr(md5(o_orderpriority), 1, 6) || '-' || CASE WHEN o_custkey % 3 = 0 THEN 'None' ELSE substr(md5(o_custkey::VARCHAR), 1, 6) END AS id FROM orders")
def _(t):
    third = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", scalars.id_of(F.col("o_orderstatus"), F.col("o_orderpriority"), third).alias("id"))


@query("group_hash", "SELECT event_type, substr(md5(string_agg(DISTINCT user_id::VARCHAR, ' ' ORDER BY user_id::VARCHAR)), 1, 6) AS id FROM events GROUP BY event_type")
def _(t):
    users = t.events.groupBy("event_type").agg(F.array_sort(F.collect_set(F.col("user_id").cast("string"))).alias("u"))
    return users.select("event_type", F.substring(F.md5(F.concat_ws(" ", "u").cast("binary")), 1, 6).alias("id"))


@query("invert_map", "SELECT n_regionkey, r_name AS key, max(n_name) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    m = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name"))).alias("m"))
    return m.select("n_regionkey", F.explode(scalars.inverted(F.col("m"))).alias("key", "value"))


@query("sort_map", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS pos, n_name AS key FROM nation")
def _(t):
    m = t.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return m.select("n_regionkey", F.posexplode(scalars.sorted_map(F.col("m"))).alias("pos", "e")).select("n_regionkey", F.col("pos").cast("long").alias("pos"), F.col("e.key").alias("key"))


@query("all_ints", "SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def _(t):
    last = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return t.events.select("event_id", scalars.all_ints(F.array(F.lit("12"), last)).alias("ok"))


@query("clean_country_name", r"SELECT n_nationkey, trim(regexp_replace(lower(n_name || '-' || n_nationkey || ' (x)'), '[^a-z\s]', ' ', 'g')) AS name FROM nation")
def _(t):
    return t.nation.select("n_nationkey", scalars.plain_country(F.concat(F.col("n_name"), F.lit("-"), F.col("n_nationkey").cast("string"), F.lit(" (x)"))).alias("name"))


@query("meters_to_degree", "SELECT s_suppkey, round(greatest(s_acctbal / 111132.95, s_acctbal / (111132.95 * cos(radians(s_nationkey * 3.0)))), 9) AS deg FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_acctbal < 0")
def _(t):
    return t.supplier.select("s_suppkey", F.round(scalars.metres_to_degrees(F.col("s_acctbal"), F.col("s_nationkey") * 3.0), 9).alias("deg"))


@query("time_id", "SELECT entity, min(time)::VARCHAR || right(max(time)::VARCHAR, 2) AS id FROM (SELECT DISTINCT c_nationkey AS entity, year(o_orderdate) AS time FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY entity")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("entity"))
    y = F.year("o_orderdate")
    return o.agg(scalars.time_id(F.min(y), F.max(y)).alias("id"))


@query("tag_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'V' WHEN 'view' THEN 'N' ELSE 'X' END AS tag FROM events")
def _(t):
    return t.events.select("event_id", scalars.tag(F.col("event_type"), {"click": "VERB", "view": "NOUN"}, {"VERB": "V", "NOUN": "N"}).alias("tag"))


@query("beta_pdf", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity BETWEEN 0 AND 60 THEN 12.0 / pow(60, 4) * l_quantity * pow(60 - l_quantity, 2) ELSE 0 END, 9) AS density FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(scalars.beta_density(F.col("l_quantity"), 2, 3, 0, 60), 9).alias("density"))


@query("tilde_restore", "SELECT p_partkey, min(c) AS restored FROM part, (SELECT unnest(['small ring', 'red widget', 'large box']) AS c) WHERE starts_with(c, p_name[1:2]) AND ends_with(c, p_name[-2:]) GROUP BY p_partkey")
def _(t):
    names = F.array(*(F.lit(x) for x in ("large box", "red widget", "small ring")))
    a, b = F.substring("p_name", 1, 2), F.substring("p_name", -2, 2)
    found = F.filter(names, lambda c: F.startswith(c, a) & F.endswith(c, b))
    return t.part.select("p_partkey", F.get(found, F.lit(0)).alias("restored")).where("restored IS NOT NULL")


@query("first_matching_line", "SELECT doc_id, CASE WHEN k > 0 THEN k - 1 END AS line FROM (SELECT doc_id, coalesce(list_position(list_transform(string_split(text, chr(10)), lambda l: contains(l, 'tion')), true), 0)::BIGINT AS k FROM documents)")
def _(t):
    return t.documents.select("doc_id", select.first_line_with(F.col("text"), "tion").alias("line"))


@query("interval_contains", "SELECT l_orderkey, l_linenumber, coalesce(l_quantity >= 10 AND l_quantity < 20, false) AS inside FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", select.in_interval(F.col("l_quantity"), F.lit(10), F.lit(20)).alias("inside"))


@query("prediction_grid_terms", "SELECT p_partkey, round(1.5 + 0.25 * p_size - 0.01 * p_size * p_size, 6) AS y FROM part")
def _(t):
    x = F.col("p_size")
    return rounded(t.part.select("p_partkey", (1.5 + 0.25 * x - 0.01 * x * x).alias("y")), "y")


@query("lcs_similarity", """WITH n AS (SELECT DISTINCT p_name, 'red widget' AS w FROM part), l AS (SELECT p_name, w, list_reduce(list_transform(string_split(p_name, ''), lambda c: [ord(c)::BIGINT]), lambda r, c:
  list_transform(range(1, 11), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN ord(w[k]) = c[1] THEN CASE WHEN k = 1 THEN 0 ELSE r[k - 1] END + 1 ELSE r[k] END))),
  list_transform(range(10), lambda i: 0::BIGINT))[10] AS n FROM n)
  SELECT p_name, CASE WHEN contains(p_name, w) OR contains(w, p_name) THEN least(len(p_name), 10) / greatest(len(p_name), 10) ELSE n / greatest(len(p_name), 10) END AS similarity FROM l""")
def _(t):
    names = t.part.select("p_name").distinct()
    return names.select("p_name", python_udfs.lcs_similarity(F.col("p_name"), F.lit("red widget")).alias("similarity"))


@query("fuzzy_ratio")
def _(t):
    names = t.part.select("p_name").distinct()
    return names.select("p_name", python_udfs.fuzzy_ratio(F.col("p_name"), F.lit("red widget")).alias("ratio"))


@query("word_wrap")
def _(t):
    return t.conversations.select("conv_id", "turn", python_udfs.wrapped(F.col("text"), 60).alias("text"))


@query("decode_bytes", "SELECT doc_id, md5(text) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(scalars.decoded(F.col("text").cast("binary")).cast("binary")).alias("h"))
