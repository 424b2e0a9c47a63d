"""Names: countries in tokens, variants of country names, variables and their transformations, stop words."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ArgumentValueError
from ..functions import python_udfs
from . import ordered

#: Fixed value: the one token that stands for a country without being its demonym.
SPECIAL = {"uk": "united kingdom"}
#: Territories that a converter of country names is told besides its own table (pattern, name, official name, code, continent).
TERRITORIES = [
    ("bonaire", "Bonaire", "Bonaire, Saint Eustatius and Saba", "BES", "America"),
    ("antilles", "Netherlands Antilles", "Netherlands Antilles", "ANT", "America"),
    ("serbia", "Serbia", "Serbia", "SER", "Europe"),
    ("east timor", "East Timor", "East Timor", "TLS", "Asia"),
]


def countries_in(df: DataFrame, token: str, countries: Sequence[str], demonyms: Mapping[str, str], least: float = 0.9) -> DataFrame:
    """df with the country that a token means, or null.

    A demonym stands for its country. Names that are equal are joined; only the distinct tokens that are
    left are held against all countries, by the share of their longest common subsequence: the best from `least` on
    wins, and of equals the later country. The lists are the parameters and small.
    """
    spark = df.sparkSession
    known = F.create_map(*(F.lit(x) for p in {**demonyms, **SPECIAL}.items() for x in p))
    each = df.select(F.col(token).alias("_t")).where(F.col(token).isNotNull()).distinct().withColumn("_n", F.coalesce(F.try_element_at(known, F.col("_t")), F.col("_t")))
    each = each.withColumn("_n", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SPECIAL.items() for x in p)), F.col("_n")), F.col("_n")))
    table = F.broadcast(spark.createDataFrame([(k, c) for k, c in enumerate(countries)], "_k int, _c string"))
    exact = each.join(table, F.col("_n") == F.col("_c")).groupBy("_t").agg(F.min_by("_c", "_k").alias("country"))
    rest = each.join(exact, "_t", "left_anti").join(table, F.lit(True)).withColumn("_s", python_udfs.lcs_similarity(F.col("_n"), F.col("_c")))
    near = rest.where(F.col("_s") >= least).groupBy("_t").agg(F.max_by("_c", F.struct("_s", "_k")).alias("country"))
    found = exact.unionByName(near)
    return df.join(found, F.col(token) == F.col("_t"), "left").drop("_t")


def converted(df: DataFrame, column: str, patterns: Sequence[tuple[str, str]], name: str = "country", unknown: str = "not found") -> DataFrame:
    """The name of the first pattern (without case) that is found in a column; the table of patterns is the parameter."""
    out = F.lit(unknown)
    for pattern, to in reversed(patterns):
        out = F.when(F.col(column).rlike(f"(?i){pattern}"), F.lit(to)).otherwise(out)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), out))


def territories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERRITORIES, "pattern string, name string, official string, code string, continent string")


TRANSFORMATIONS = ("log", "square", "boxcox")


def transformed(df: DataFrame, variable: str, transformation: str | None = None) -> str:
    """The column that holds a variable, transformed or not; it must be there."""
    if transformation is None:
        return variable
    if transformation not in TRANSFORMATIONS:
        raise ArgumentValueError(f"one of {TRANSFORMATIONS}")
    if f"{variable}_{transformation}" not in df.columns:
        raise ArgumentValueError(f"no column {variable}_{transformation}")
    return f"{variable}_{transformation}"


def short(column: Column) -> Column:
    """Three letters of each word and the whole last one, without &, - and commas."""
    words = F.split(F.translate(column, "&-,", ""), " ")
    cut = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, w).otherwise(F.substring(w, 1, 3)))
    return F.array_join(F.filter(cut, lambda w: w != ""), "")


def short_names(variables: Iterable[Mapping[str, Sequence[str]]], names: Mapping[str, str], log: bool = False) -> list[dict[str, list[str]]]:
    """Models as {dependent: [independent, ...]} with mapped names, the logarithm of a variable where it is known and asked for."""
    pick = lambda v: names[f"{v}_log" if log and f"{v}_log" in names else v]
    return [{pick(k): [pick(v) for v in values]} for model in variables for k, values in model.items()]


class StopWords:
    """A set of stop words that can be changed and stored; Spark's own lists are the languages."""

    def __init__(self, spark: SparkSession, language: str | None = "english"):
        from pyspark.ml.feature import StopWordsRemover

        self.spark, self.words = spark, set(StopWordsRemover.loadDefaultStopWords(language)) if language else set()

    def add(self, *words: str) -> None:
        self.words.update(words)

    def remove(self, *words: str) -> None:
        self.words.difference_update(words)

    def save(self, path: str) -> None:
        self.spark.createDataFrame([(w,) for w in sorted(self.words)], "word string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StopWords:
        out = cls(spark, None)
        out.words = {r.word for r in spark.read.parquet(path).collect()}
        return out

    def without(self, tokens: Column) -> Column:
        """An array of tokens without the stop words, whatever their case."""
        low = [w.lower() for w in sorted(self.words)]
        return F.filter(tokens, lambda t: ~F.lower(t).isin(low)) if low else tokens


def network_columns(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with label as name, edges with width as weight, 1.0 where there is none."""
    width = F.coalesce(F.col("width").cast("double"), F.lit(1.0)) if "width" in edges.columns else F.lit(1.0)
    out = edges.withColumn("weight", width).drop("width")
    return (nodes.withColumnRenamed("label", "name") if "label" in nodes.columns else nodes), out


def distinct_frames(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """The frames without those that equal a later one, as multisets of rows; only a hash of each reaches the driver."""
    marks = []
    for f in frames:
        h = F.xxhash64(*f.columns) if f.columns else F.lit(0)
        row = f.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first()
        marks.append((tuple(f.dtypes), *row))
    return [f for k, f in enumerate(frames) if marks[k] not in marks[k + 1 :]]


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """Rows of each group numbered from 1; over a whole table by ranges of the first column."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ordered.ranked(df, order[0], "first", name=name, tie=order[-1])
