"""Projection, selection and predicates. Every function is DataFrame -> DataFrame and runs no job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentTypeError, ArgumentValueError


def checked(df: DataFrame, columns: str | Iterable[str]) -> list[str]:
    """The names as a list; unknown names and other types raise."""
    if isinstance(columns, str):
        columns = [columns]
    if isinstance(columns, Mapping) or not isinstance(columns, Iterable):
        raise ArgumentTypeError(f"column names must be a text or texts, not {type(columns).__name__}")
    names = list(columns)
    if missing := [c for c in names if c not in df.columns]:
        raise ArgumentValueError(f"no such columns: {missing}; the table has {df.columns}")
    return names


def rows_by_label(df: DataFrame, key: str, labels: object, must_exist: bool = False) -> DataFrame:
    """Rows whose key is one of the labels; must_exist runs one small job and raises for unknown labels."""
    wanted = list(labels) if isinstance(labels, (list, tuple, set)) else [labels]
    checked(df, key)
    if must_exist:
        there = {r[0] for r in df.where(F.col(key).isin(wanted)).select(key).distinct().collect()}
        if unknown := [x for x in wanted if x not in there]:
            raise ArgumentValueError(f"no rows with {key} in {unknown}")
    return df.where(F.col(key).isin(wanted))


def columns_by_label(df: DataFrame, labels: str | Iterable[str], level: int | None = None, separator: str = "|") -> DataFrame:
    """Columns in the order asked for; with a level, those with a label at that place of a name a|b|c, in table order."""
    wanted = [labels] if isinstance(labels, str) else list(labels)
    if level is None:
        return df.select(*(F.col(f"`{c}`") for c in checked(df, wanted)))
    parts = {c: c.split(separator) for c in df.columns}
    found = [c for c, p in parts.items() if level < len(p) and p[level] in wanted]
    if not found:
        raise ArgumentValueError(f"no column has {wanted} at level {level}")
    return df.select(*(F.col(f"`{c}`") for c in found))


def label_slice(level: str, values: object):
    """A predicate builder for one level: apply it to a table."""
    wanted = list(values) if isinstance(values, (list, tuple, set)) else [values]
    return lambda df: df.where(F.col(checked(df, level)[0]).isin(wanted))


def full_text(df: DataFrame, columns: Iterable[str], name: str = "full_text") -> DataFrame:
    """Columns as text, joined by a space; a missing value becomes the text nan."""
    return df.withColumn(name, F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in checked(df, columns))))


def renamed(df: DataFrame, names: Mapping[str, str], inverse: bool = False) -> DataFrame:
    """Rename by a map or its inverse; targets must be unique and new."""
    use = {v: k for k, v in names.items()} if inverse else dict(names)
    if inverse and len(use) != len(names):
        raise ArgumentValueError("the map cannot be inverted: a target comes twice")
    checked(df, list(use))
    if len(set(use.values())) != len(use) or set(use.values()) & (set(df.columns) - set(use)):
        raise ArgumentValueError("new names must be unique and not in the table")
    return df.withColumnsRenamed(use)


def matching(df: DataFrame, column: str, pattern: str, case: bool = False) -> DataFrame:
    """Rows whose text matches a Java pattern somewhere."""
    return df.where(F.col(checked(df, column)[0]).rlike(pattern if case else f"(?i){pattern}"))


def look_ahead(words: Iterable[str], union: str = "|") -> str:
    """A pattern of one look-ahead for each text, in lower case, joined by union."""
    return union.join(f"(?=.*{w.lower()})" for w in words)


def group_or_all(df: DataFrame, column: str, group: object, everything: object) -> DataFrame:
    return df if group == everything else df.where(F.col(checked(df, column)[0]) == F.lit(group))


def keys_with_text(df: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """All rows of the keys that have the text in some row's column."""
    return df.join(df.where(F.col(column).contains(text)).select(key).distinct(), key, "left_semi")


def by_custom_order(df: DataFrame, column: str, order: Iterable[str]) -> DataFrame:
    """Adds the rank of a category in a given order and sorts by it; others come last."""
    ranks = F.create_map(*(F.lit(x) for pair in ((v, i) for i, v in enumerate(order)) for x in pair))
    ranked = df.withColumn("rank", F.coalesce(F.try_element_at(ranks, F.col(column)), F.lit(len(list(order)))))
    return ranked.orderBy("rank", column)


def named_codes(df: DataFrame, code: str, names: DataFrame, name_key: str, name: str) -> DataFrame:
    """Join a small dimension of names; a code without a name keeps its code as text."""
    found = df.join(names.select(F.col(name_key).alias("_k"), F.col(name).alias("display")), F.col(code) == F.col("_k"), "left")
    return found.withColumn("display", F.coalesce("display", F.col(code).cast("string"))).drop("_k")


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.groupBy(*checked(df, keys)).agg(F.count("*").alias("n")).where("n > 1")


def in_interval(value: Column, left: Column, right: Column) -> Column:
    """left <= value < right; a null anywhere is false."""
    return F.coalesce((value >= left) & (value < right), F.lit(False))


def saturated(df: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """Groups with at least so many distinct items."""
    return df.groupBy(group).agg(F.count_distinct(item).alias("n_items")).where(F.col("n_items") >= least)


def between_times(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    return df.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def first_line_with(text: Column, part: str) -> Column:
    """The 0-based number of the first line that holds the part, or null."""
    hits = F.transform(F.split(text, "\n"), lambda line: F.contains(line, F.lit(part)))
    return F.nullif(F.array_position(hits, True), F.lit(0)) - 1


def first_of(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """One row a key: the first by the order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")
