"""Queries of selection, joins, sets, reshapes, sources and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..operators import distributions, reshape, select
from ..sources import records, tables
from ..streaming import pending
from .base import PANEL, panel, query, rounded

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("scan_project", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return tables.read_table(t.spark, "orders", ["o_orderkey", "o_totalprice"], t.folder)


@query("select_rows_by_label", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    return select.rows_by_label(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY"], must_exist=True).select("c_custkey", "c_mktsegment")


@query("select_columns", "SELECT n_name, n_nationkey FROM nation")
def _(t):
    return select.columns_by_label(t.nation, ["n_name", "n_nationkey"])


@query("select_columns_level", f'SELECT time, sum(total) FILTER (segment = \'BUILDING\')::DECIMAL(38, 2)::DOUBLE AS "BUILDING|total" FROM {PANEL} GROUP BY time')
def _(t):
    wide = reshape.pivoted(panel(t), ["time"], "segment", SEGMENTS, "total").withColumnsRenamed({s: f"{s}|total" for s in SEGMENTS})
    kept = select.columns_by_label(wide, ["BUILDING"], level=0)
    return kept.join(wide.select("time", F.col("`BUILDING|total`").alias("_x")), F.col("`BUILDING|total`") == F.col("_x")).select("time", F.round("`BUILDING|total`", 2).alias("BUILDING|total"))


@query("idxslice_filter", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def _(t):
    return select.label_slice("l_returnflag", ["A", "R"])(t.lineitem).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("full_text", "SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, 'nan') || ' ' || user_id AS full_text FROM events")
def _(t):
    e = t.events.withColumn("kind", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return select.full_text(e, ["kind", "user_id"]).select("event_id", "full_text")


@query("rename_columns", "SELECT r_regionkey AS id, r_name AS name FROM region")
def _(t):
    return select.renamed(t.region, {"id": "r_regionkey", "name": "r_name"}, inverse=True)


@query("filter_pattern", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)RED|w.d')")
def _(t):
    return select.matching(t.part, "p_name", "RED|w.d").select("p_partkey")


@query("relevance_lookahead", "SELECT p_partkey, contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') AS any_word, contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring') AS all_words FROM part")
def _(t):
    name, words = F.lower("p_name"), ["Red", "Ring"]
    return t.part.select("p_partkey", name.rlike(select.look_ahead(words)).alias("any_word"), name.rlike(select.look_ahead(words, "")).alias("all_words"))


@query("group_or_all", "SELECT 'one' AS kind, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'all', count(*) FROM events")
def _(t):
    parts = [select.group_or_all(t.events, "event_type", g, "All").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, g in (("one", "click"), ("all", "All"))]
    return parts[0].union(parts[1])


@query("semi_join_ids_by_substring", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE contains(event_type, 'err')) GROUP BY user_id")
def _(t):
    return select.keys_with_text(t.events, "user_id", "event_type", "err").groupBy("user_id").agg(F.count("*").alias("n"))


@query("custom_category_order", "SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS rank FROM customer")
def _(t):
    return select.by_custom_order(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "BUILDING"])


@query("code_to_name_join", "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS display FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def _(t):
    return select.named_codes(t.customer, "c_nationkey", t.nation.where("n_nationkey < 20"), "n_nationkey", "n_name").select("c_custkey", "display")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return select.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("saturated_groups", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_items FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 4")
def _(t):
    return select.saturated(t.orders, "o_custkey", "o_orderpriority", 4)


@query("events_between", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-03 12:00:00'")
def _(t):
    return select.between_times(t.events, "ts", "2024-01-02 00:00:00", "2024-01-03 12:00:00").select("event_id")


@query("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("resume_pending", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def _(t):
    return pending.pending(t.events.select("event_id"), t.events.where("event_type = 'click'"), "event_id")


@query("resume_budget", "SELECT event_id FROM events WHERE event_type <> 'click' ORDER BY event_id LIMIT 25")
def _(t):
    return pending.resume(t.events.select("event_id"), t.events.where("event_type = 'click'"), "event_id", "event_id", 25)


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return pending.windowed_counts(t.events, "ts", ["event_type"])


@query("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 8000").select("s_nationkey"))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return tables.union_distinct([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))])


@query("union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


@query("distinct_values", "SELECT DISTINCT event_type, user_id FROM events")
def _(t):
    return t.events.select("event_type", "user_id").distinct()


@query("events_by_date", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY day")
def _(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("flatten_array", "SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' ')) || [p_brand]) AS x FROM part")
def _(t):
    return t.part.select("p_partkey", F.explode(F.flatten(F.array(F.array_distinct(F.split("p_name", " ")), F.array("p_brand")))).alias("x"))


# ---- reshapes ----------------------------------------------------------------------------------

_WIDE = ", ".join(f"round(sum(total) FILTER (segment = '{s}'), 2) AS \"{s}\"" for s in SEGMENTS)


@query("pivot_table", f"SELECT entity, time, {_WIDE.replace('round(', 'coalesce(round(').replace(', 2)', ', 2), 0)')} FROM {PANEL} GROUP BY entity, time")
def _(t):
    return rounded(reshape.pivoted(panel(t), ["entity", "time"], "segment", SEGMENTS, "total", fill=0.0), *SEGMENTS, digits=2)


@query("melt", "SELECT c_custkey, 'c_acctbal' AS variable, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::DOUBLE FROM customer")
def _(t):
    return reshape.melted(t.customer, ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query("reshape_group", f"SELECT time, {_WIDE} FROM (SELECT DISTINCT time FROM {PANEL}) LEFT JOIN (SELECT * FROM {PANEL} WHERE entity = (SELECT min(n_name) FROM nation)) USING (time) GROUP BY time")
def _(t):
    p = panel(t)
    wanted = t.nation.agg(F.min("n_name")).first()[0]
    return rounded(reshape.group_panel(p, "entity", wanted, "segment", SEGMENTS, "total", "time"), *SEGMENTS, digits=2)


@query("reshape_groups_subgroups", "SELECT time, " + ", ".join(f"round(sum(total) FILTER (region = '{r}' AND segment = '{s}'), 2) AS \"{r}|{s}\"" for r in ("ASIA", "EUROPE") for s in SEGMENTS[:2]) + """ FROM (SELECT year(o_orderdate)::INT AS time, r_name AS region, c_mktsegment AS segment, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY time""")
def _(t):
    p = panel(t).join(t.nation, F.col("entity") == F.col("n_name")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "region")
    pairs = [(r, s) for r in ("ASIA", "EUROPE") for s in SEGMENTS[:2]]
    return rounded(reshape.groups_panel(p, "region", "segment", pairs, "total", "time"), *("|".join(x) for x in pairs), digits=2)


@query("entity_series", f"SELECT time, round(sum(total), 2) AS total, sum(n) AS n FROM (SELECT DISTINCT time FROM {PANEL}) LEFT JOIN (SELECT * FROM {PANEL} WHERE entity = (SELECT max(n_name) FROM nation)) USING (time) GROUP BY time")
def _(t):
    wanted = t.nation.agg(F.max("n_name")).first()[0]
    return rounded(reshape.entity_series(panel(t), "entity", wanted, ["total", "n"], "time"), "total", digits=2)


@query("entities_panel", f"SELECT time, round(sum(total) FILTER (segment = 'BUILDING'), 2) AS BUILDING_total, sum(n) FILTER (segment = 'BUILDING') AS BUILDING_n, round(sum(total) FILTER (segment = 'MACHINERY'), 2) AS MACHINERY_total, sum(n) FILTER (segment = 'MACHINERY') AS MACHINERY_n FROM {PANEL} GROUP BY time HAVING count(*) FILTER (segment IN ('BUILDING', 'MACHINERY')) > 0")
def _(t):
    return rounded(reshape.entities_panel(panel(t), "segment", ["BUILDING", "MACHINERY"], ["total", "n"], "time"), "BUILDING_total", "MACHINERY_total", digits=2)


@query("cluster_growth", "SELECT time, event_type, count(e.event_id)::DOUBLE AS n FROM (SELECT * FROM (SELECT DISTINCT ts::DATE AS time FROM events), (SELECT DISTINCT event_type FROM events)) LEFT JOIN (SELECT event_id, ts::DATE AS time, event_type FROM events) e USING (time, event_type) GROUP BY ALL")
def _(t):
    return reshape.counts_by_period(t.events.withColumn("time", F.to_date("ts")), "time", "event_type").select("time", "event_type", "n")


@query("cluster_growth_share", "SELECT time, event_type, round(100 * n / sum(n) OVER (PARTITION BY time), 6) AS n FROM (SELECT time, event_type, count(e.event_id) AS n FROM (SELECT * FROM (SELECT DISTINCT ts::DATE AS time FROM events), (SELECT DISTINCT event_type FROM events)) LEFT JOIN (SELECT event_id, ts::DATE AS time, event_type FROM events) e USING (time, event_type) GROUP BY ALL)")
def _(t):
    return rounded(reshape.counts_by_period(t.events.withColumn("time", F.to_date("ts")), "time", "event_type", percent=True).select("time", "event_type", "n"), "n")


@query("sort_within_block", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer")
def _(t):
    return reshape.sorted_blocks(t.customer, "c_mktsegment", "c_acctbal", "c_custkey").select("c_mktsegment", "c_custkey", "place")


@query("share_quartiles", f"SELECT time, segment, round(avg(total), 4) AS mean, round(quantile_cont(total, 0.25), 4) AS q25, round(quantile_cont(total, 0.75), 4) AS q75 FROM {PANEL} GROUP BY ALL")
def _(t):
    return rounded(reshape.mean_and_quartiles(panel(t), ["time", "segment"], "total"), "mean", "q25", "q75", digits=4)


@query("stacked_cumsum", f"SELECT entity, segment, time, round(sum(total) OVER (PARTITION BY entity, time ORDER BY segment ROWS UNBOUNDED PRECEDING), 3) AS running FROM {PANEL}")
def _(t):
    return rounded(distributions.running(panel(t), ["entity", "time"], ["segment"], "total").select("entity", "segment", "time", "running"), "running", digits=3)


# ---- sources -----------------------------------------------------------------------------------


def _scratch(t, name: str) -> str:
    return scratch.path(t.spark, name)


@query("html_img_extract", r"""SELECT page_id, i - 1 AS pos, regexp_extract(src[i], '([^/]*)$', 1) AS file FROM (SELECT page_id, regexp_extract_all(html, '<img[^>]*src=["'']([^"'']*)["'']', 1) AS src FROM pages), unnest(range(1, len(src) + 1)) AS u(i)""")
def _(t):
    return tables.image_names(t.pages, ["page_id"], "html").withColumn("pos", F.col("pos").cast("long"))


@query("html_links", r"""SELECT page_id, len(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1))::BIGINT AS n FROM pages""")
def _(t):
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"""href=["']([^"']*)["']"""), 1)).cast("long").alias("n"))


@query("csv_union", "SELECT r_regionkey::VARCHAR AS key, r_name AS name, NULL AS region FROM region UNION SELECT n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation")
def _(t):
    a, b = _scratch(t, "csv"), _scratch(t, "csv")
    t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).write.option("header", True).csv(a)
    t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.option("header", True).csv(b)
    return tables.union_distinct([tables.read_csvs(t.spark, [a, b])])


@query("sequence_roundtrip", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def _(t):
    path = _scratch(t, "sequence")
    tables.store_sequence(t.events.select("event_id", "event_type"), "event_type", path)
    return tables.load_sequence(t.spark, "event_type", path, ["click", "view"]).select("event_id", "event_type")


@query("etl_relevant_docs", r"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(lang, 'nan') || ' ' || text, '(?i)licen[cs]e|idiot')")
def _(t):
    def make():
        docs = select.full_text(select.renamed(t.documents, {"doc_id": "id"}), ["lang", "text"])
        return select.matching(docs, "full_text", "licen[cs]e|idiot").select(F.col("id").alias("doc_id"))

    return tables.computed_once(t.spark, _scratch(t, "etl"), make)


@query("json_flatten", "SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events")
def _(t):
    return t.events.select("event_id", records.json_number(F.col("props"), "$.k").alias("k"))


@query("json_explode", "SELECT s_nationkey AS request, 'p' || s_suppkey AS id, s_name AS name, round(s_acctbal, 2) AS latitude, 0.0::DOUBLE AS longitude, 'shop,depot' AS types, -1.0::DOUBLE AS rating, s_nationkey::INT AS ratings FROM supplier")
def _(t):
    place = F.struct(F.concat(F.lit("p"), F.col("s_suppkey")).alias("id"), F.struct(F.col("s_name").alias("text")).alias("displayName"), F.struct(F.col("s_acctbal").alias("lat")).alias("location"), F.array(F.lit("shop"), F.lit("depot")).alias("types"), F.col("s_nationkey").alias("userRatingCount"))
    answers = t.supplier.groupBy(F.col("s_nationkey").alias("request")).agg(F.to_json(F.struct(F.collect_list(place).alias("places"))).alias("json"))
    return rounded(records.places(answers, ["request"], "json"), "latitude", digits=2)


@query("ics_parse", "SELECT 'u' || event_id AS uid, event_type AS summary, date_trunc('second', ts) AS start, NULL::TIMESTAMP AS \"end\", user_id || '@x.org' AS organizer, 'a,b' AS attendees FROM events")
def _(t):
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    text = F.concat_ws("\n", F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT"), F.concat(F.lit("UID:u"), F.col("event_id")), F.concat(F.lit("SUMMARY:"), F.col("event_type")), F.concat(F.lit("DTSTART:"), stamp), F.concat(F.lit("ORGANIZER;CN=x:mailto:"), F.col("user_id"), F.lit("@x.org")), F.lit("ATTENDEE:mailto:a\nATTENDEE:mailto:b\nEND:VEVENT\nEND:VCALENDAR"))
    found = records.parsed(t.events.select(text.alias("text")), "calendar_events", "text", [])
    return found.select("uid", "summary", "start", "end", "organizer", F.array_join("attendees", ",").alias("attendees"))


@query("stata_log_parse", "SELECT p_partkey, 0 AS model, 'regress' AS command, 'y' AS dependent, 'x' || p_size AS term, round(p_retailprice, 2) AS coef, 0.5 AS se FROM part")
def _(t):
    row = F.concat(F.lit("   x"), F.col("p_size"), F.lit(" |  "), F.format_string("%.2f", "p_retailprice"), F.lit("   .5   2.10   0.036    -1.5    2.5"))
    text = F.concat(F.lit(". regress y x1 x2\n------\n    y | Coef.  Std. Err. t P>|t| [95% Conf. Interval]\n"), row, F.lit("\n"))
    found = records.parsed(t.part.select("p_partkey", text.alias("text")), "log_coefficients", "text", ["p_partkey"])
    return found.select("p_partkey", "model", "command", "dependent", "term", "coef", F.col("se").cast("decimal(2,1)").alias("se"))


@query("token_cost", "SELECT role, sum(len(string_split(text, ' ')))::BIGINT AS prompt_tokens, sum(length(text))::BIGINT AS answer_tokens, round((sum(len(string_split(text, ' '))) * 2.5 + sum(length(text)) * 10) / 1000000, 9) AS cost FROM conversations GROUP BY role")
def _(t):
    c = t.conversations.select("role", F.size(F.split("text", " ")).cast("long").alias("a"), F.length("text").cast("long").alias("b"))
    return rounded(pending.usage(c, "role", "a", "b", 2.5, 10.0), "cost", digits=9)
