"""Small files and folders: JSON, texts, the place of a database, polygons of a GeoJSON file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole JSON files: an object or an array of objects each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, text: str, path: str) -> None:
    df.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)


def database_folder(spark: SparkSession, name: str = "default") -> str:
    return spark.catalog.getDatabase(name).locationUri


def use_database(spark: SparkSession, name: str, folder: str | None = None) -> None:
    """The named database, made in a folder if it isn't there, becomes the current one."""
    at = f" LOCATION '{folder}'" if folder else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{at}")
    spark.catalog.setCurrentDatabase(name)


def pretty(c: Column) -> Column:
    """A map or struct as indented JSON."""
    return F.to_json(c, {"pretty": "true"})


POSITION = "array<double>"
GEOJSON = f"features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(feature, part, properties, ring): the outer rings of the polygons of GeoJSON files, as arrays of (lon, lat)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", GEOJSON).alias("j"))
    rows = raw.select(F.posexplode("j.features").alias("feature", "f")).select("feature", F.col("f.properties").alias("properties"), F.col("f.geometry").alias("g"))
    one = F.array(F.from_json("g.coordinates", f"array<array<{POSITION}>>"))
    many = F.from_json("g.coordinates", f"array<array<array<{POSITION}>>>")
    parts = F.when(F.col("g.type") == "Polygon", one).when(F.col("g.type") == "MultiPolygon", many)
    rows = rows.select("feature", "properties", F.posexplode(parts).alias("part", "rings"))
    return rows.select("feature", "part", "properties", F.col("rings")[0].alias("ring"))


def bounds(rings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, west, south, east, north) of rings: the bounds of their union."""
    points = rings.select(*by, F.explode("ring").alias("p"))
    x, y = F.col("p")[0], F.col("p")[1]
    return points.groupBy(*by).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))
