"""Coefficient tables of regressions by quantile: from wide results to one long, classified, sorted table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQUARE = "_square"


def unwrapped(term: Column) -> Column:
    """The name inside I(name), or the term itself."""
    return F.regexp_replace(term, r"^I\((.*)\)$", "$1")


def long(wide: DataFrame, term: str, quantiles: Sequence[str]) -> DataFrame:
    """(variable, quantile, value) of a table with a column for each quantile."""
    cells = F.array(*(F.struct(F.lit(float(q)).alias("quantile"), F.col(f"`{q}`").alias("value")) for q in quantiles))
    return wide.select(unwrapped(F.col(term)).alias("variable"), F.explode(cells).alias("c")).select("variable", "c.*")


def classified(coefficients: DataFrame, independent: Sequence[str], kind: str, dependent: str) -> DataFrame:
    """With the regression's type, degree and dependent variable, and Exog or Control for each variable.

    The degree is quadratic if the square of every independent variable is there.
    """
    names = F.broadcast(coefficients.agg(F.collect_set(F.when(F.col("variable").isin([f"{v}{SQUARE}" for v in independent]), F.col("variable"))).alias("_s")))
    own = F.regexp_replace("variable", f"{SQUARE}$", "").isin(list(independent))
    degree = F.when(F.size("_s") == len(set(independent)), "quadratic").otherwise("linear")
    rows = coefficients.crossJoin(names)
    return rows.select(F.lit(kind).alias("type"), degree.alias("degree"), F.lit(dependent).alias("dependent"), F.when(own, "Exog").otherwise("Control").alias("role"), "variable", "quantile", "value")


def sorted_rows(table: DataFrame) -> DataFrame:
    """Independent variables first, then by name and quantile."""
    return table.orderBy(F.desc("role"), "variable", "quantile")


def by_quantile(table: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """A row for each variable and a column q<quantile> for each quantile."""
    wide = table.groupBy("type", "degree", "dependent", "role", "variable").pivot("quantile", list(quantiles)).agg(F.first("value"))
    return wide.select("type", "degree", "dependent", "role", "variable", *(F.col(f"`{float(q)}`").alias(f"q{round(100 * q)}") for q in quantiles))


def identified(table: DataFrame, length: int = 12) -> DataFrame:
    """With an id of the regression: a hash of its type, degree and variables."""
    one = table.groupBy("type", "degree", "dependent").agg(F.array_join(F.sort_array(F.collect_set("variable")), ",").alias("_v"))
    one = one.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "type", "degree", "_v"), 256), 1, length)).drop("_v")
    return table.join(one, ["type", "degree", "dependent"])


def displayed(df: DataFrame, column: str, names: dict[str, str], pattern: str | None = None) -> DataFrame:
    """Display names: the part a pattern's group finds, looked up in names; others stay."""
    key = F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, 1)).otherwise(F.col(column)) if pattern else F.col(column)
    if not names:
        return df.withColumn(column, key)
    return df.withColumn(column, F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), key), key))
