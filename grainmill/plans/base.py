"""Registration of queries with their SQL, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with the SQL that gives the same rows."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return make

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


CELLS = """(SELECT n_name AS origin, p_brand AS product, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
RCA = f"""(SELECT origin, product, coalesce(value * sum(value) OVER () / nullif(sum(value) OVER (PARTITION BY origin) * sum(value) OVER (PARTITION BY product), 0), 0) AS rca FROM {CELLS})"""
PRESENT = f"(SELECT origin, product FROM {RCA} WHERE rca >= 1)"
NEAR = f"""(SELECT a.product AS i, b.product AS j, count(*) / greatest(any_value(ki.k), any_value(kj.k)) AS weight FROM {PRESENT} a JOIN {PRESENT} b USING (origin)
  JOIN (SELECT product, count(*) AS k FROM {PRESENT} GROUP BY product) ki ON ki.product = a.product
  JOIN (SELECT product, count(*) AS k FROM {PRESENT} GROUP BY product) kj ON kj.product = b.product WHERE a.product <> b.product GROUP BY a.product, b.product)"""
PANEL = """(SELECT n_name AS entity, year(o_orderdate)::INT AS time, c_mktsegment AS segment, sum(o_totalprice) AS total, count(*)::DOUBLE AS n FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def cells(t: Tables) -> DataFrame:
    """Sales by the supplier's nation (origin) and the part's brand (product)."""
    sold = t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice")
    sold = sold.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return sold.groupBy(F.col("n_name").alias("origin"), F.col("p_brand").alias("product")).agg(F.sum("l_extendedprice").alias("value"))


def rca(t: Tables) -> DataFrame:
    """Written once a query, as it is small and read several times: every use would add up the sales again."""
    from .. import scratch
    from ..operators import complexity

    if "_rca" not in t.__dict__:
        sums = scratch.written(cells(t), "cells")
        t.__dict__["_rca"] = scratch.written(complexity.advantage(sums).select("origin", "product", "rca"), "rca")
    return t.__dict__["_rca"]


def present(t: Tables) -> DataFrame:
    return rca(t).where("rca >= 1").select("origin", "product")


def near(t: Tables) -> DataFrame:
    from ..operators import complexity

    return complexity.proximity(present(t))


def panel(t: Tables) -> DataFrame:
    """Orders by nation, year and market segment."""
    o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("entity"), F.year("o_orderdate").alias("time"), F.col("c_mktsegment").alias("segment")).agg(
        F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n")
    )
