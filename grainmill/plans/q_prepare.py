"""Queries of typing, scaling, binning, ranks and lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, prep
from .base import PANEL, panel, query, rounded

ODD = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE value::VARCHAR END"


def _odd(t):
    """Values as texts, some missing and some that are no number."""
    text = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", text.alias("v"))


@query("prepare_int", f"SELECT event_id, coalesce(trunc(TRY_CAST({ODD} AS DOUBLE)), -1)::BIGINT AS v FROM events")
def _(t):
    return prep.to_int(_odd(t), ["v"], -1)


@query("prepare_str", "SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, 'nan') AS v FROM events")
def _(t):
    return prep.to_text(t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("v")), ["v"])


@query("prepare_date", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN date_trunc('day', o_orderdate) END, TIMESTAMP '1900-01-01') AS v FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("none")
    return prep.to_time(t.orders.select("o_orderkey", text.alias("v")), ["v"], "1900-01-01 00:00:00", "yyyy/MM/dd")


@query("prepare_bool", "SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_id % 3 <> 0 END, false) AS a, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type <> 'click' END, false) AS b FROM events")
def _(t):
    some = F.col("event_id") % 7 != 0
    text = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return prep.to_bool(t.events.select("event_id", F.when(some, F.col("event_id") % 3).alias("a"), F.when(some, text).alias("b")), ["a", "b"])


@query("prepare_categorical", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN c_mktsegment END AS c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 END AS c_mktsegment_code FROM customer")
def _(t):
    return prep.to_categories(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["MACHINERY", "BUILDING"], ordered=True)


@query("standardize", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def _(t):
    return rounded(prep.standardized(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal")


@query("normalize_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 4 - 2, 6) AS p_retailprice FROM part")
def _(t):
    return rounded(prep.min_max(t.part.select("p_partkey", "p_retailprice"), ["p_retailprice"], -2.0, 2.0), "p_retailprice")


@query("normalize_share", f"SELECT entity, round(s / sum(s) OVER (), 9) AS share FROM (SELECT entity, sum(total) AS s FROM {PANEL} GROUP BY entity)")
def _(t):
    return rounded(prep.share(panel(t).groupBy("entity").agg(F.sum("total").alias("s")), "s").select("entity", "share"), "share", digits=9)


@query("bin_equal_width", "SELECT event_id, CASE WHEN value IS NOT NULL THEN least(10, greatest(1, ceil((value - min(value) OVER ()) / ((max(value) OVER () - min(value) OVER ()) / 10.0::DOUBLE))))::INT END AS bin FROM events")
def _(t):
    return prep.equal_width_bins(t.events.select("event_id", "value"), "value", 10).select("event_id", "bin")


@query("bin_edges", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 1 WHEN p_size > 10 AND p_size <= 25 THEN 2 WHEN p_size > 25 AND p_size <= 40 THEN 3 END AS bin FROM part")
def _(t):
    return t.part.select("p_partkey", prep.edge_bins(F.col("p_size"), [0, 10, 25, 40]).alias("bin"))


@query("quantile_bins", "SELECT event_id, 1 + (value > q[1])::INT + (value > q[2])::INT + (value > q[3])::INT AS quantile FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)")
def _(t):
    return prep.quantile_bins(t.events.select("event_id", "value"), "value", 4).select("event_id", "quantile")


@query("quantile_bins_by_group", "SELECT event_id, event_type, 1 + (value > q[1])::INT + (value > q[2])::INT + (value > q[3])::INT AS quantile FROM events JOIN (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events GROUP BY event_type) USING (event_type)")
def _(t):
    return prep.quantile_bins(t.events.select("event_id", "event_type", "value"), "value", 4, ["event_type"]).select("event_id", "event_type", "quantile")


@query("log_transform", "SELECT event_id, round(ln(CASE WHEN x = 0 THEN 1e-6 ELSE x END), 6) AS x_ln FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE abs(value) + 0.5 END AS x FROM events)")
def _(t):
    x = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.abs("value") + 0.5)
    return rounded(prep.mapped(t.events.select("event_id", x.alias("x")), ["x"], F.ln, "ln").select("event_id", "x_ln"), "x_ln")


@query("growth_abs", f"SELECT entity, segment, time, round(total - lag(total, 1) OVER (PARTITION BY entity, segment ORDER BY time), 4) AS total_growth_1 FROM {PANEL}")
def _(t):
    return rounded(prep.growth(panel(t), ["total"], 1, ["time"], ["entity", "segment"]).select("entity", "segment", "time", "total_growth_1"), "total_growth_1", digits=4)


@query("growth_pct", f"SELECT entity, segment, time, round((n - lag(n, 1) OVER (PARTITION BY entity, segment ORDER BY time)) / n * 100, 6) AS \"n_growth%_1\" FROM {PANEL}")
def _(t):
    return rounded(prep.growth(panel(t), ["n"], 1, ["time"], ["entity", "segment"], percent=True).select("entity", "segment", "time", "n_growth%_1"), "n_growth%_1")


@query("shift_columns", "SELECT event_id, lag(value, 2) OVER w AS value_shifted_2, lead(value, 1) OVER w AS \"value_shifted_-1\" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    e = prep.shifted(t.events, ["value"], 2, ["ts", "event_id"], ["user_id"])
    return prep.shifted(e, ["value"], -1, ["ts", "event_id"], ["user_id"]).select("event_id", "value_shifted_2", "value_shifted_-1")


@query("col_arith", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_tax, 6) AS "l_quantity_+_l_tax", round(l_quantity - l_tax, 6) AS "l_quantity_-_l_tax",
  round(l_quantity * l_tax, 6) AS "l_quantity_*_l_tax", round(l_quantity / nullif(l_tax, 0), 6) AS "l_quantity_/_l_tax" FROM lineitem""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    for op in "+-*/":
        d = prep.arithmetic(d, ["l_quantity"], "l_tax", op)
    return rounded(d.drop("l_quantity", "l_tax"), *(f"l_quantity_{op}_l_tax" for op in "+-*/"))


@query("bijective_map", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END AS flag FROM lineitem")
def _(t):
    names = prep.NameMap({"a": "accepted", "n": "none", "r": "returned"}, case=False)
    return t.lineitem.select("l_orderkey", "l_linenumber", names.apply(F.col("l_returnflag")).alias("flag"))


_RANK = {
    "average": "(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0)::DOUBLE",
    "min": "rank() OVER (ORDER BY l_quantity)",
    "max": "rank() OVER (ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_quantity) - 1",
    "dense": "dense_rank() OVER (ORDER BY l_quantity)",
}
for _method, _sql in _RANK.items():

    @query(f"rank_{_method}", f"SELECT l_orderkey, l_linenumber, l_partkey, {_sql} AS rank FROM lineitem")
    def _(t, method=_method):
        return ordered.ranked(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity", method).drop("l_quantity")


@query("rank_first", "SELECT event_id, row_number() OVER (ORDER BY round(value), event_id) AS rank FROM events WHERE value IS NOT NULL")
def _(t):
    e = t.events.where("value IS NOT NULL").select("event_id", F.round("value", 0).alias("v"))
    return ordered.ranked(e, "v", "first", tie="event_id").select("event_id", "rank")
