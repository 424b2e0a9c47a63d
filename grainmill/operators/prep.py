"""Typing, scaling, binning and lags of columns.

Statistics of a whole column come from one aggregate whose single row is joined back, never from a
window over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentValueError
from . import ordered
from .select import checked


def _number(c: Column) -> Column:
    x = c.cast("string").try_cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def to_int(df: DataFrame, columns: Sequence[str], placeholder: int, errors: str = "coerce") -> DataFrame:
    """Whole numbers, cut toward zero; what is no number gets the placeholder, or raises at run time."""
    if errors not in ("coerce", "raise"):
        raise ArgumentValueError("errors is coerce or raise")
    parse = _number if errors == "coerce" else (lambda c: c.cast("double"))
    return df.withColumns({c: F.coalesce(parse(F.col(c)), F.lit(float(placeholder))).cast("long") for c in checked(df, columns)})


def to_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts; a missing value becomes nan."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in checked(df, columns)})


def to_time(df: DataFrame, columns: Sequence[str], placeholder: str, pattern: str | None = None) -> DataFrame:
    """Timestamps by a Java pattern; what does not parse gets the placeholder."""
    parse = lambda c: F.try_to_timestamp(F.col(c), F.lit(pattern)) if pattern else F.try_to_timestamp(F.col(c))
    return df.withColumns({c: F.coalesce(parse(c), F.lit(placeholder).cast("timestamp")) for c in checked(df, columns)})


def to_bool(df: DataFrame, columns: Sequence[str], placeholder: bool = False) -> DataFrame:
    """Truth as in Python: empty texts and zeros are false, any other value, the text False too, is true."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        x = F.col(c)
        true = x if kinds[c] == "boolean" else (x != "") if kinds[c] == "string" else (x != 0)
        return F.coalesce(true, F.lit(placeholder))

    return df.withColumns({c: one(c) for c in checked(df, columns)})


def to_categories(df: DataFrame, columns: Sequence[str], categories: Sequence[str], ordered: bool = False) -> DataFrame:
    """Values that aren't listed become null; ordered adds <column>_code, the place in the list."""
    names = checked(df, columns)
    out = df.withColumns({c: F.when(F.col(c).isin(list(categories)), F.col(c)) for c in names})
    code = F.create_map(*(F.lit(x) for i, v in enumerate(categories) for x in (v, i)))
    return out.withColumns({f"{c}_code": F.try_element_at(code, F.col(c)) for c in names}) if ordered else out


def _with_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Every row beside the single row of aggregates."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample standard deviation."""
    for c in checked(df, columns):
        df = _with_row(df, F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s")).withColumn(c, F.try_divide(F.col(c) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    return df


def min_max(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Into [low, high]; a constant column becomes low."""
    for c in checked(df, columns):
        wide = _with_row(df, F.min(c).alias("_a"), F.max(c).alias("_b"))
        span = F.when(F.col("_b") == F.col("_a"), F.lit(1.0)).otherwise(F.col("_b") - F.col("_a"))
        df = wide.withColumn(c, (F.col(c) - F.col("_a")) / span * (high - low) + low).drop("_a", "_b")
    return df


def share(df: DataFrame, column: str, name: str = "share", by: Sequence[str] = ()) -> DataFrame:
    """x over the sum of x, of the table or of each group."""
    if by:
        return df.withColumn(name, F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(*by))))
    return _with_row(df, F.sum(column).alias("_t")).withColumn(name, F.try_divide(F.col(column), F.col("_t"))).drop("_t")


def equal_width_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins 1 .. n of one width, closed on the right, the least value in the first; outside or null: null."""
    wide = _with_row(df, F.min(column).alias("_a"), F.max(column).alias("_b"))
    step = (F.col("_b") - F.col("_a")) / F.lit(float(bins))
    bin_ = F.when(step == 0, F.lit(1)).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(column) - F.col("_a")) / step))))
    return wide.withColumn(name, F.when(F.col(column).isNotNull(), bin_).cast("int")).drop("_a", "_b")


def edge_bins(column: Column, edges: Sequence[float]) -> Column:
    """Which of the intervals (e0, e1], (e1, e2] ... holds the value, from 1; null outside."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when((column > a) & (column <= b), F.lit(i + 1))
    return out


def quantile_bins(df: DataFrame, column: str, q: int, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """Quantile bins 1 .. q with exact interpolated edges, closed on the right, the least value in the first.

    The edges are computed by an aggregate and joined back, for the table or for each group.
    """
    if q < 2:
        raise ArgumentValueError("at least two quantiles")
    edges = ordered.quantiles(df, column, [i / q for i in range(1, q)], by, "_e")
    wide = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))
    bin_ = F.size(F.filter("_e", lambda e: F.col(column) > e)) + 1
    return wide.withColumn(name, F.when(F.col(column).isNotNull(), bin_)).drop("_e")


def mapped(df: DataFrame, columns: Sequence[str], how: Callable[[Column], Column], name: str, rename: bool = True) -> DataFrame:
    """A Column function on each column, as <column>_<name> or in place; ln and log take 1e-6 for zero."""
    safe = (lambda c: F.when(c == 0, F.lit(1e-6)).otherwise(c)) if name in ("ln", "log") else (lambda c: c)
    return df.withColumns({f"{c}_{name}" if rename else c: how(safe(F.col(c))) for c in checked(df, columns)})


def shifted(df: DataFrame, columns: Sequence[str], t: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The value t rows before (or after, if t < 0) in an order that must be given, as <column>_shifted_<t>."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{c}_shifted_{t}": F.lag(c, t).over(w) if t >= 0 else F.lead(c, -t).over(w) for c in checked(df, columns)})


def growth(df: DataFrame, columns: Sequence[str], t: int, order: Sequence[str], by: Sequence[str] = (), percent: bool = False) -> DataFrame:
    """x minus x t rows before; percent divides by the current value, times 100."""
    w = Window.partitionBy(*by).orderBy(*order)

    def one(c: str) -> Column:
        change = F.col(c) - F.lag(c, t).over(w)
        return F.try_divide(change, F.col(c)) * 100 if percent else change

    return df.withColumns({f"{c}_growth{'%' if percent else ''}_{t}": one(c) for c in checked(df, columns)})


def arithmetic(df: DataFrame, columns: Sequence[str], other: str, op: str) -> DataFrame:
    """column op other as <column>_<op>_<other>; a division by zero gives null."""
    use = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}[op]
    return df.withColumns({f"{c}_{op}_{other}": use(F.col(c), F.col(other)) for c in checked(df, [*columns, other])[:-1]})


class NameMap:
    """A one-to-one map of names, usable both ways on columns."""

    def __init__(self, pairs: dict[str, str], case: bool = True, pass_unknown: bool = False):
        keys = pairs if case else {k.lower(): v for k, v in pairs.items()}
        if len(set(pairs.values())) != len(pairs) or len(keys) != len(pairs):
            raise ArgumentValueError("names must be unique on both sides")
        self.pairs, self.case, self.pass_unknown = pairs, case, pass_unknown

    def apply(self, c: Column, inverse: bool = False) -> Column:
        pairs = {v: k for k, v in self.pairs.items()} if inverse else self.pairs
        fold = (lambda s: s) if self.case else str.lower
        table = F.create_map(*(F.lit(x) for k, v in pairs.items() for x in (fold(k), v)))
        found = F.try_element_at(table, c if self.case else F.lower(c))
        return F.coalesce(found, c) if self.pass_unknown else found
