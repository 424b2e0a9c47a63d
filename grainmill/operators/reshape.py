"""Pivot, unpivot and dense panels. Pivot values are passed in or read once from a distinct, never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentValueError
from . import ordered
from .select import checked

AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "median": F.median, "nunique": F.count_distinct,
}


def aggregate(how: str, value: str, order: str | None = None) -> Column:
    """An aggregate by name; first is the first value that isn't null in an order that must be given."""
    if how == "first":
        if order is None:
            raise ArgumentValueError("first needs an order")
        return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return AGGREGATES[how](value)


def pivoted(df: DataFrame, index: Sequence[str], columns: str, values: Sequence[str], value: str, how: str = "sum", order: str | None = None, fill: object = None) -> DataFrame:
    """Long to wide with the given values as columns; fill replaces nulls."""
    out = df.where(F.col(columns).isin(list(values))).groupBy(*checked(df, index)).pivot(columns, list(values)).agg(aggregate(how, value, order))
    return out if fill is None else out.fillna(fill)


def melted(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in checked(df, values))).unpivot(list(ids), list(values), variable, value)


def on_all_times(df: DataFrame, times: DataFrame, time: str) -> DataFrame:
    """One row for each time of another table."""
    return times.select(time).distinct().join(df, time, "left")


def group_panel(df: DataFrame, group: str, wanted: str, subgroup: str, subgroups: Sequence[str], value: str, time: str, how: str = "sum", order: str | None = None) -> DataFrame:
    """One group's subgroups as columns over all times of the whole table."""
    one = df.where(F.col(group) == wanted)
    return on_all_times(pivoted(one, [time], subgroup, subgroups, value, how, order), df, time)


def groups_panel(df: DataFrame, group: str, subgroup: str, pairs: Sequence[tuple[str, str]], value: str, time: str, how: str = "sum", order: str | None = None) -> DataFrame:
    """Columns group|subgroup over all times, in one aggregation."""
    keyed = df.withColumn("_c", F.concat_ws("|", group, subgroup))
    return on_all_times(pivoted(keyed, [time], "_c", ["|".join(p) for p in pairs], value, how, order), df, time)


def entity_series(df: DataFrame, entity: str, wanted: str, values: Sequence[str], time: str, how: str = "sum", order: str | None = None) -> DataFrame:
    """Several columns of one entity over all times."""
    one = df.where(F.col(entity) == wanted).groupBy(time).agg(*(aggregate(how, v, order).alias(v) for v in values))
    return on_all_times(one, df, time)


def entities_panel(df: DataFrame, entity: str, entities: Sequence[str], values: Sequence[str], time: str, how: str = "sum") -> DataFrame:
    """Columns entity_value over the times."""
    return df.where(F.col(entity).isin(list(entities))).groupBy(time).pivot(entity, list(entities)).agg(*(aggregate(how, v).alias(v) for v in values))


def dense_grid(df: DataFrame, rows: str, columns: str, value: str) -> DataFrame:
    """Every pair of a row key and a column key, with the sum of the value or 0; long, not wide.

    The grid has as many rows as the matrix has cells, which is the result that is asked for.
    """
    cells = df.groupBy(rows, columns).agg(F.sum(value).alias(value))
    keys = ordered.small(df.select(columns).where(F.col(columns).isNotNull()).distinct())
    grid = df.select(rows).where(F.col(rows).isNotNull()).distinct().join(keys, F.lit(True))
    return grid.join(cells, [rows, columns], "left").fillna(0.0, [value])


def counts_by_period(df: DataFrame, time: str, cluster: str, percent: bool = False) -> DataFrame:
    """Rows for each time and cluster, zeros included, or their percent of the time's rows."""
    n = dense_grid(df.withColumn("n", F.lit(1).cast("double")), time, cluster, "n")
    if percent:
        n = n.withColumn("n", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(time)))
    return n


def sorted_blocks(df: DataFrame, block: str, by: str, tie: str, descending: bool = True) -> DataFrame:
    """Number the rows of each block by a column."""
    key = F.col(by).desc() if descending else F.col(by).asc()
    return df.withColumn("place", F.row_number().over(Window.partitionBy(block).orderBy(key, tie)))


def mean_and_quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = ordered.quantiles(df, value, [0.25, 0.75], keys, "_q").select(*keys, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q75"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(q, list(keys))
