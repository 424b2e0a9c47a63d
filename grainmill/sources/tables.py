"""Tables by name, CSV folders, keyed sequences of tables, and cached pipelines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentTypeError, ArgumentValueError
from ..operators.select import checked


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table_exists(spark: SparkSession, name: str, folder: str | None = None) -> bool:
    """A catalog table, or else folder/name.parquet."""
    return spark.catalog.tableExists(name) or (folder is not None and path_exists(spark, f"{folder}/{name}.parquet"))


def read_table(spark: SparkSession, name: str, columns: str | Sequence[str] | None = None, folder: str | None = None) -> DataFrame:
    """A table, or only some of its columns; the projection reaches the scan."""
    if columns is not None and not isinstance(columns, (str, list, tuple)):
        raise ArgumentTypeError("columns is a name or names")
    df = spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(f"{folder}/{name}.parquet")
    return df if columns is None else df.select(*checked(df, columns))


def read_tables(spark: SparkSession, names: Iterable[str], columns: str | Sequence[str] | None = None, folder: str | None = None) -> list[DataFrame]:
    return [read_table(spark, n, columns, folder) for n in names]


def copy_table(df: DataFrame, name: str, if_exists: str = "fail") -> None:
    """Save under a catalog name: fail, replace or append."""
    modes = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
    if if_exists not in modes:
        raise ArgumentValueError(f"if_exists is one of {sorted(modes)}")
    df.write.mode(modes[if_exists]).saveAsTable(name)


def store(df: DataFrame, folder: str, name: str, overwrite: bool = False) -> str:
    path = f"{folder}/{name}.parquet"
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def store_sequence(df: DataFrame, key: str, path: str) -> None:
    """Tables by key as one dataset partitioned by the key, so that reading some keys prunes the rest."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def sequence_keys(spark: SparkSession, key: str, path: str) -> set[str]:
    return {str(r[0]) for r in spark.read.parquet(path).select(key).distinct().collect()}


def is_sequence(spark: SparkSession, key: str, path: str, keys: Iterable[object]) -> bool:
    """Are exactly these keys stored?"""
    try:
        return sequence_keys(spark, key, path) == {str(k) for k in keys}
    except AnalysisException:
        return False


def load_sequence(spark: SparkSession, key: str, path: str, keys: Iterable[object] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if keys is None:
        return df
    if missing := {str(k) for k in keys} - sequence_keys(spark, key, path):
        raise ArgumentValueError(f"not stored: {sorted(missing)}")
    return df.where(F.col(key).isin(list(keys)))


def read_csvs(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """CSV files with headers, whose columns may differ, as one table of texts."""
    frames = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p) for p in paths]
    if not frames:
        raise ArgumentValueError("no files")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct()


def computed_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], recalculate: bool = False) -> DataFrame:
    """The table stored at a path, made and stored first if it isn't there."""
    if recalculate or not path_exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): one row a file."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def image_names(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """(keys, pos, file): the base names of the images of a page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""<img[^>]*src=["']([^"']*)["']"""), 1)
    return df.select(*keys, F.posexplode(found).alias("pos", "src")).withColumn("file", F.regexp_extract("src", r"([^/]*)$", 1)).drop("src")


def strip_tags(html: str) -> str:
    return re.sub(r"<[^>]+>", " ", html)
